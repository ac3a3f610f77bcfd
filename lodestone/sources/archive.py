"""What format the files of a mail archive are in: decided by the folder that a file lies in, its name and its first lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes and lines of a file that are looked at.
HEAD, LINES = 4096, 20
#: Files that show what kind of folder they lie in.
MARKS = {".mh_sequences": "mh", ".overview": "nnml", ".marks": "nnml", "active": "nnml"}


def folder_marks(df: DataFrame) -> DataFrame:
    """folder, mark: the folders that hold a file which shows their kind, and maildirs by their cur, new and tmp."""
    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    kind = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[name]
    marked = df.select(folder.alias("folder"), kind.alias("mark")).where("mark is not null")
    leaf, root = F.regexp_extract("folder", "([^/]*)$", 1), F.regexp_extract("folder", "^(.*)/[^/]*$", 1)
    boxes = df.select(folder.alias("folder")).distinct().select(root.alias("root"), leaf.alias("leaf")).where(F.col("leaf").isin("cur", "new", "tmp"))
    boxes = boxes.groupBy("root").agg(F.count_distinct("leaf").alias("n")).where("n > 1")
    maildirs = boxes.select(F.explode(F.array(F.concat("root", F.lit("/cur")), F.concat("root", F.lit("/new")))).alias("folder"), F.lit("maildir").alias("mark"))
    return marked.unionByName(maildirs).groupBy("folder").agg(F.min("mark").alias("mark"))


def detected(df: DataFrame, requested: str | None = None) -> DataFrame:
    """path and format of each file (path, content) of an archive: maildir, mbox, nnml, mh, eml-dir, or null where it is no mail.

    Hidden files are none. A name that ends in .eml is a message; one in cur or new of a folder with another of cur, new and tmp, or
    with flags in its name, a maildir's; a number is mh's or nnml's by what lies beside it, nnml's where nothing tells. A name without a dot whose
    first line begins with `From ` is an mbox; else a header line among the first lines, before a blank one, makes a message.
    A requested format goes before all. Folders are told from the names of all files, so files are read by their first bytes alone.
    """
    if requested and requested != "auto":
        return df.select("path", F.lit(requested).alias("format"))
    head = F.decode(F.substring("content", 1, HEAD), "ISO-8859-1")
    rows = df.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), head.alias("head"))
    rows = rows.join(folder_marks(df), "folder", "left")
    lines = F.slice(F.split("head", "\r?\n", LINES + 1), 1, LINES)
    before = F.array_position(F.transform(lines, lambda x: F.trim(x) == ""), F.lit(True))
    header = F.exists(F.when(before > 0, F.slice(lines, F.lit(1), (before - 1).cast("int"))).otherwise(lines), lambda x: F.lower(x).rlike("^(message-id|from|subject):"))
    inside = F.regexp_extract("folder", "([^/]*)$", 1).isin("cur", "new")
    number = F.col("name").rlike("^[0-9]+$")
    found = (
        F.when(F.col("name").startswith(".") | F.col("name").isin(*MARKS), None)
        .when(F.lower("name").endswith(".eml"), "eml-dir")
        .when(inside & ((F.col("mark") == "maildir") | F.contains("name", F.lit(":2,"))), "maildir")
        .when(number & (F.col("mark") == "mh"), "mh")
        .when(number, "nnml")
        .when(~F.contains("name", F.lit(".")) & ~F.endswith("name", F.lit("~")) & F.startswith("head", F.lit("From ")), "mbox")
        .when(header, "eml-dir")
    )
    return rows.select("path", found.alias("format"))
