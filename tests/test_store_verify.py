"""One seeded fault of each code is found, and shows in what contains it."""

import hashlib

import pytest

from lodestone.operators import store_verify as sv

H = lambda x: hashlib.sha256(x.encode()).hexdigest()
C = lambda *parts: H("compound\n" + "\n".join(f"{r}:{d}" for r, d in parts))


def whole():
    """Three blobs, a compound of two of them, and one around that."""
    blobs = {k: f"content {k}" for k in "abc"}
    digest = {k: H(x) for k, x in blobs.items()}
    digest["t"] = C(("user", digest["a"]), ("assistant", digest["b"]))
    digest["box"] = C(("user", digest["t"]), ("user", digest["c"]))
    return {
        "manifests": [[k, d, d, k in ("t", "box"), 1] for k, d in digest.items()],
        "blobs": [[k, x, x.encode()] for k, x in blobs.items()],
        "parts": [["t", "a", "user", 0], ["t", "b", "assistant", 1], ["box", "t", "user", 0], ["box", "c", "user", 1]],
        "recovery": [[k, digest[k], digest[k], len(blobs[k]), digest[k]] for k in blobs],
        "sources": [[k] for k in blobs],
    }


SCHEMAS = {
    "manifests": "object string, digest string, manifest_digest string, compound boolean, facets int",
    "blobs": "object string, content string, compressed_bytes binary",
    "parts": "object string, part string, role string, ord int",
    "recovery": "object string, digest string, uncompressed string, size int, compressed string",
    "sources": "object string",
}


def found(spark, rows):
    return {(r.object, r.code) for r in sv.findings(**{k: spark.createDataFrame(x, SCHEMAS[k]) for k, x in rows.items()}, roles=("user", "assistant")).collect()}


def change(table, row, column, value):
    def run(rows):
        rows[table][row][column] = value

    return run


def remove(table, row):
    return lambda rows: rows[table].pop(row)


FAULTS = [
    (change("manifests", 0, 4, 0), {("a", "manifest_missing_facets")}),
    (change("manifests", 3, 2, "other"), {("t", "manifest_digest_mismatch")}),
    (change("blobs", 0, 1, None), {("a", "blob_read_failed")}),
    (change("blobs", 1, 1, "changed"), {("b", "blob_digest_mismatch"), ("b", "recovery_uncompressed_hash_mismatch"), ("t", "compound_digest_mismatch"), ("box", "compound_digest_mismatch")}),
    (change("parts", 3, 2, "nobody"), {("box", "compound_invalid_part"), ("box", "compound_digest_mismatch")}),
    (lambda rows: rows["parts"].append(["box", "gone", "user", 2]), {("box", "compound_dangling_part")}),
    (lambda rows: rows["parts"].__setitem__(slice(0, 2), [["t", "b", "assistant", 0], ["t", "a", "user", 1]]), {("t", "compound_digest_mismatch"), ("box", "compound_digest_mismatch")}),
    (remove("recovery", 2), {("c", "recovery_missing")}),
    (change("recovery", 2, 1, "other"), {("c", "recovery_digest_mismatch")}),
    (change("recovery", 0, 2, "other"), {("a", "recovery_uncompressed_hash_mismatch")}),
    (change("recovery", 0, 3, 1), {("a", "recovery_compressed_size_mismatch")}),
    (change("recovery", 1, 4, "other"), {("b", "recovery_compressed_hash_mismatch")}),
    (remove("sources", 1), {("b", "source_index_missing")}),
]


@pytest.mark.parametrize("k", range(len(FAULTS)))
def test_each_fault_is_found(spark, k):
    rows = whole()
    fault, wanted = FAULTS[k]
    fault(rows)
    assert found(spark, rows) == wanted


def test_a_sound_store_and_a_cycle(spark):
    assert found(spark, whole()) == set()
    rows = whole()
    rows["parts"] += [["x", "y", "user", 0], ["y", "x", "user", 0]]
    rows["manifests"] += [["x", "1", "1", True, 1], ["y", "2", "2", True, 1]]
    assert found(spark, rows) == set()  # what has no digest has no wrong one


def test_codes():
    assert set(sv.CODES) == {code for _, wanted in FAULTS for _, code in wanted}
