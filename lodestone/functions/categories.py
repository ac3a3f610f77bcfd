"""Rule-based message categories and dictionary families, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category rules. A rule holds if every field it names contains one of its strings; "domain" is looked up in
# the sender.
RULES: list[tuple[str, dict[str, list[str]]]] = [
    ("camera_alert", {"domain": ["notifications.ui.com"]}),
    ("call_notice", {"domain": ["ringcentral.com"]}),
    ("dev_activity", {"domain": ["github.com"]}),
    ("dev_activity", {"domain": ["gitlab.com"]}),
    ("dev_ci", {"domain": ["github.com"], "subject": ["ci", "workflow", "run failed"]}),
    ("dev_ci", {"domain": ["gitlab.com"], "subject": ["pipeline"]}),
    ("dev_review", {"domain": ["github.com"], "body": ["pull request", "review", "commented"]}),
    ("security_admin", {"domain": ["google.com"], "sender": ["workspace-alerts"]}),
    ("security_admin", {"domain": ["gitlab.com"], "subject": ["password", "passkey", "verify your identity"]}),
    ("financial_statement", {"domain": ["interactivebrokers.com"]}),
    ("financial_statement", {"subject": ["statement", "e-statement", "invoice", "receipt"]}),
    ("mailing_list", {"domain": ["tuhs.org"]}),
    ("newsletter", {"sender": ["newsletter", "daily"], "subject": ["daily", "weekly"]}),
    ("promotion", {"labels": ["category_promotions"]}),
    ("social", {"labels": ["category_social"]}),
    ("social", {"domain": ["redditmail.com"]}),
    ("social", {"domain": ["linkedin.com"]}),
    ("social", {"domain": ["patreon.com"]}),
    ("real_estate", {"subject": ["subject removal", "possession date", "completion date", "rolston"]}),
    ("corporate_filing", {"subject": ["corporation", "corporations canada", "french name"]}),
    ("legal", {"subject": ["strata plan", "owners", "v.", "eps1755"]}),
    ("family", {"sender": ["erin@", "couple@"], "labels": ["1people/erin"]}),
    ("health_appointment", {"subject": ["vet appointment", "appointment", "seniors panel"]}),
    ("home_services", {"subject": ["tree care", "payment received", "invoice"], "labels": ["1house"]}),
    ("work", {"labels": ["1work"]}),
]
#: Categories that are hidden unless asked for.
HIDDEN = ["camera_alert", "machine_notification", "bulk_status_noise", "call_notice", "dev_activity", "dev_review", "mailing_list"]


# Senders that stand for a code host, as alternatives of (field, strings).
HOSTS = {
    "hub": [[("sender", ["notifications@github.com"])], [("text", ["noreply.github.com"])]],
    "lab": [[("sender", ["gitlab@mg.gitlab.com"])]],
}
# First categories; `primary` stands where none of them holds. A category holds where all (field, strings) of one of its
# alternatives do, a field by any of its strings: as a part, a label as a whole, `begins` at the subject's start, `host` by HOSTS.
BASE = [
    ("camera_alert", [("sender", ["notifications.ui.com", "unifi os"])]),
    ("camera_alert", [("text", ["unifi.ui.com"])]),
    ("camera_alert", [("text", ["smart detection"]), ("text", ["recorded an animal", "protect/events"])]),
    ("news_alert", [("sender", ["googlealerts-noreply@google.com"])]),
    ("admin_alert", [("sender", ["google-workspace-alerts-noreply@google.com"])]),
    ("promotion", [("label", ["category_promotions"])]),
    ("update", [("label", ["category_updates"])]),
]
# Categories that hold beside those, in the same form.
MORE = [
    ("call_notice", [("sender", ["notify@ringcentral.com", "service@ringcentral.com"])]),
    ("call_notice", [("begins", ["new call"])]),
    ("security_admin", [("sender", ["google-workspace-alerts-noreply@google.com"])]),
    ("security_admin", [("text", ["verify your identity", "password changed"])]),
    ("security_admin", [("host", ["lab"]), ("subject", ["password changed", "passkey", "verify your identity"])]),
    ("financial_statement", [("sender", ["interactivebrokers.com"])]),
    ("financial_statement", [("subject", ["statement"])]),
    ("financial_statement", [("text", ["trade confirmation"])]),
    ("mailing_list", [("sender", ["tuhs.org"])]),
    ("mailing_list", [("label", ["category_forums"])]),
    ("newsletter", [("sender", ["newsletter", "daily@"])]),
    ("newsletter", [("subject", ["weekly"])]),
    ("social", [("label", ["category_social"])]),
    ("social", [("sender", ["redditmail.com", "linkedin.com", "patreon.com"])]),
    ("dev_activity", [("host", ["hub", "lab"])]),
    ("dev_review", [("host", ["hub"]), ("text", ["commented on this pull request", "review", "requested"])]),
    ("dev_ci", [("host", ["hub"]), ("text", ["workflow run"])]),
    ("dev_ci", [("host", ["hub"]), ("subject", ["ci", "run failed"])]),
    ("dev_ci", [("host", ["lab"]), ("text", ["pipeline"])]),
    ("dev_ci", [("host", ["lab"]), ("subject", ["failed pipeline", "fixed pipeline"])]),
]


def _either(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _holds(m: Column, field: str, strings: list[str]) -> Column:
    """Whether a field of the message m shows any of the strings."""
    if field == "host":
        return _either([_all(m, way) for s in strings for way in HOSTS[s]])
    if field == "label":
        return _either([F.array_contains(m["label"], s) for s in strings])
    if field == "begins":
        return _either([F.startswith(m["subject"], F.lit(s)) for s in strings])
    return _either([F.contains(m[field], F.lit(s)) for s in strings])


def _all(m: Column, way: list[tuple[str, list[str]]]) -> Column:
    out = _holds(m, *way[0])
    for field, strings in way[1:]:
        out = out & _holds(m, field, strings)
    return out


def categories(sender: Column, subject: Column, snippet: Column, body: Column, labels: Column) -> Column:
    """The sorted categories of a message; labels are joined by blanks. `primary` stays only beside `update` or alone.

    The message's fields are lower-cased once, as one struct that all rules read.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    message = F.struct(
        low(sender).alias("sender"), low(sender).alias("domain"), low(subject).alias("subject"), F.split(low(labels), " ").alias("label"), low(labels).alias("labels"),
        F.concat_ws(" ", low(snippet), low(body)).alias("body"), F.concat_ws(" ", low(subject), low(sender), low(snippet), F.substring(low(body), 1, 2000)).alias("text"),
    )
    rules = [(name, list(rule.items())) for name, rule in RULES]

    def found(m: Column) -> Column:
        pick = lambda table: F.array_compact(F.array(*[F.when(_all(m, way), F.lit(name)) for name, way in table]))
        return F.struct(pick(BASE).alias("base"), pick([*MORE, *rules]).alias("more"))

    both = F.get(F.transform(F.array(message), found), F.lit(0))
    every = F.transform(F.array(both), lambda x: F.array_distinct(F.concat(F.when(F.size(x["base"]) == 0, F.array(F.lit("primary"))).otherwise(x["base"]), x["more"])))
    kept = F.transform(every, lambda x: F.array_sort(F.when(F.exists(x, lambda c: ~c.isin("update", "primary")), F.array_remove(x, "primary")).otherwise(x)))
    return F.get(kept, F.lit(0))


# Media types of each dictionary family, tried in this order after the roles.
FAMILIES: list[tuple[str, list[str]]] = [
    ("mail_headers", ["message/rfc822", "text/rfc822-headers"]),
    ("rdf_turtle", ["text/turtle", "application/n-triples", "application/ld+json"]),
    ("structured_json", ["application/json"]),
    ("structured_xml", ["application/xml", "text/xml", "application/xhtml+xml", "image/svg+xml"]),
    ("html_css_js", ["text/html", "text/css", "text/javascript", "application/javascript"]),
    ("csv_tsv", ["text/csv", "text/tab-separated-values"]),
    ("binary_serialization", ["application/x-protobuf", "application/protobuf", "application/msgpack", "application/cbor", "application/avro"]),
    ("yaml_toml", ["text/yaml", "text/x-yaml", "text/toml"]),
    ("document_markup", ["text/markdown", "text/x-rst"]),
    ("source_code", ["text/x-go", "text/x-python", "text/x-rust", "text/x-java-source", "text/x-c", "text/x-c++", "text/x-csharp", "text/x-shellscript", "text/x-sql", "application/sql", "application/graphql"]),
]
#: Suffixes that decide when no exact type did.
SUFFIXES = [("+json", "structured_json"), ("+xml", "structured_xml"), ("+cbor", "binary_serialization"), ("+msgpack", "binary_serialization"), ("+avro", "binary_serialization")]


def dictionary_family(media_type: Column, role: Column) -> Column:
    """The compression dictionary's family of an object, by its role and then its media type."""
    media = F.lower(F.trim(F.split_part(F.coalesce(media_type, F.lit("")), F.lit(";"), F.lit(1))))
    out = F.when(media == "", "opaque_binary").when(F.lower(role) == "headers", "mail_headers").when((F.lower(role) == "body") & (media == "text/html"), "mail_body_html").when(F.lower(role) == "body", "mail_body_plain").when(F.lower(role) == "patch", "patch_text")
    for family, types in FAMILIES:
        out = out.when(media.isin(types), family)
    for suffix, family in SUFFIXES:
        out = out.when(media.endswith(suffix), family)
    return out.when(media.startswith("text/"), "logs_line_oriented").otherwise("opaque_binary")
