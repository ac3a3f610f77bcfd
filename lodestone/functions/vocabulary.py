"""The vocabulary of contacts: what each predicate says, which types are contacts, what properties and services of address cards mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The prefix of this engine's own terms; another store's own terms are read by giving its prefix.
OWN = "urn:lodestone:"

# Namespaces of public vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
PREFIXES = {
    "schema": "https://schema.org/", "foaf": "http://xmlns.com/foaf/0.1/", "vcard": "http://www.w3.org/2006/vcard/ns#", "org": "http://www.w3.org/ns/org#",
    "rel": "http://purl.org/vocab/relationship/", "dcterms": "http://purl.org/dc/terms/", "gedcom": "http://www.w3.org/2000/10/swap/pim/gedcom#",
    "skos": "http://www.w3.org/2004/02/skos/core#", "owl": "http://www.w3.org/2002/07/owl#", "time": "http://www.w3.org/2006/time#", "prov": "http://www.w3.org/ns/prov#",
}

# Predicate, concept, kind of evidence, role, normaliser. The first predicate of a concept is its canonical one.
TERMS = """
own:fullName name name - text
schema:name name name - text
own:partText name-part name - text
schema:givenName given-name name - text
schema:familyName family-name name - text
schema:additionalName additional-name name - text
foaf:nick nickname name - text
schema:alternateName nickname name - text
schema:email email set locator email
schema:telephone phone set locator phone
schema:url url set locator url
foaf:name name name - text
vcard:fn name name - text
vcard:hasName name name - text
vcard:nickname nickname name - text
foaf:givenName given-name name - text
foaf:familyName family-name name - text
foaf:mbox email set locator email
vcard:hasEmail email set locator email
vcard:email email set locator email
vcard:hasTelephone phone set locator phone
vcard:tel phone set locator phone
foaf:phone phone set locator phone
foaf:homepage url set locator url
vcard:hasURL url set locator url
vcard:url url set locator url
foaf:account account set account url
own:streetAddress street-address contextual locator text
schema:streetAddress street-address contextual locator text
own:extendedAddress extended-address contextual locator text
own:postOfficeBox po-box contextual locator text
own:addressLocality locality contextual locator text
schema:addressLocality locality contextual locator text
own:addressRegion region contextual locator text
schema:addressRegion region contextual locator text
own:postalCode postal-code set locator text
schema:postalCode postal-code set locator text
own:countryCode country contextual locator text
schema:addressCountry country contextual locator text
own:latitude latitude contextual locator text
own:longitude longitude contextual locator text
own:timezone timezone contextual locator text
schema:worksFor works-for set org text
schema:affiliation works-for set org text
schema:jobTitle job-title contextual org text
schema:department department contextual org text
org:memberOf member-of set org url
schema:birthDate birth-date functional - text
schema:gender gender functional - text
schema:image image set - url
schema:description note contextual note text
dcterms:description note contextual note text
schema:knows knows set relationship url
schema:colleague colleague set relationship url
owl:sameAs same-as set identifier url
schema:sameAs same-as set identifier url
own:hasMet has-met set relationship url
own:hasWorkedWith worked-with set relationship url
own:hasAgreement has-agreement set relationship url
"""
NAME_CONCEPTS = ("name", "name-part", "given-name", "family-name", "additional-name", "nickname")

# Kind of fact, then the predicates that state one; "!" marks a historical one.
FACTS = """
relationship rel:childOf rel:parentOf rel:spouseOf own:hasAgreement own:hasMet own:hasUsed own:hasWorkedWith foaf:knows schema:knows
identifier owl:sameAs skos:exactMatch schema:identifier schema:sameAs
name vcard:fn foaf:name own:fullName schema:name
address vcard:hasAddress own:streetAddress own:extendedAddress own:postOfficeBox own:addressLocality own:addressRegion own:postalCode own:countryCode schema:address
email vcard:hasEmail foaf:mbox own:emailIdentity own:historicalEmail! schema:email
phone vcard:hasTelephone foaf:phone schema:telephone
url vcard:hasURL foaf:homepage schema:url
note vcard:note schema:description
alias vcard:nickname foaf:nick schema:alternateName
affiliation org:member schema:affiliation schema:memberOf schema:worksFor
account foaf:account
title foaf:title schema:jobTitle
contact_alias own:contactAlias
importance own:importance
coordinates own:latitude own:longitude
timezone own:timezone
"""

# Types of things that are contacts.
ENTITY_TYPES = "foaf:Person foaf:Organization foaf:Group schema:Person schema:Organization gedcom:Individual gedcom:Family vcard:Individual vcard:Organization org:Organization"

# An address card's property, its concept, and the service of a messaging account.
CARD_PROPERTIES = """
FN name
N name-structured
NICKNAME nickname
X-MAIDENNAME family-name
X-PHONETIC-LAST-NAME family-name
EMAIL email
TEL phone
X-PRIMARY-PHONE phone
URL url
FBURL url
ORG works-for
TITLE job-title
ROLE job-title
ADR address
ADDRESS address
GEO coordinates
TZ timezone
TZID timezone
BDAY birth-date
BIRTHDAY birth-date
X-GENDER gender
PHOTO image
LOGO image
NOTE note
AIM account aim
X-AIM account aim
X-AIM-ID account aim
ICQ account icq
X-ICQ account icq
X-ICQ-ID account icq
JABBER account xmpp
X-JABBER account xmpp
X-XMPP account xmpp
MSN account msn
X-MSN account msn
X-MSN-ID account msn
X-WINDOWS-LIVE account msn
YAHOO account yahoo
X-YAHOO account yahoo
X-YAHOO-ID account yahoo
X-SKYPE account skype
X-SKYPE-ID account skype
GTALK account gtalk
GOOGLE-TALK account gtalk
X-GTALK account gtalk
X-MYSPACE account myspace
IMPP account
IM account
X-IM account
X-SOCIALPROFILE account
"""

# Homepages of messaging services by their names, and the days on which some of them closed.
SERVICES = {
    "aim": "https://www.aim.com/", "icq": "https://icq.com/", "jabber": "xmpp:", "xmpp": "xmpp:", "msn": "https://www.msn.com/", "windows-live": "https://www.msn.com/", "yahoo": "https://www.yahoo.com/",
    "skype": "https://www.skype.com/", "google-talk": "https://talk.google.com/", "gtalk": "https://talk.google.com/", "myspace": "https://myspace.com/",
}
CLOSED = {"https://www.aim.com/": "2017-12-15", "https://icq.com/": "2024-06-26", "https://www.msn.com/": "2013-04-30", "https://www.yahoo.com/": "2018-07-17", "https://talk.google.com/": "2017-06-26"}


def iri(short: str, own: str = OWN) -> str:
    prefix, name = short.split(":", 1)
    return (own if prefix == "own" else PREFIXES[prefix]) + name


def terms(own: str = OWN) -> list[tuple[str, str, str, str, str]]:
    """(predicate, concept, evidence, role, normaliser) of every registered predicate; '' is no role."""
    rows = [line.split() for line in TERMS.strip().splitlines()]
    return [(iri(p, own), concept, evidence, role.strip("-"), how) for p, concept, evidence, role, how in rows]


def fact_kinds(own: str = OWN) -> list[tuple[str, str, bool]]:
    """(predicate, kind, historical) of every predicate that states a fact."""
    return [(iri(p.strip("!"), own), kind, p.endswith("!")) for kind, *preds in map(str.split, FACTS.strip().splitlines()) for p in preds]


def entity_types(own: str = OWN) -> list[str]:
    return [iri(t, own) for t in ENTITY_TYPES.split()]


def card_properties() -> list[tuple[str, str, str]]:
    """(property, concept, service homepage or '')."""
    rows = [(line.split() + [""])[:3] for line in CARD_PROPERTIES.strip().splitlines()]
    return [(prop, concept, SERVICES.get(service, "")) for prop, concept, service in rows]


def terms_table(spark: SparkSession, own: str = OWN) -> DataFrame:
    return spark.createDataFrame(terms(own), "predicate string, concept string, evidence string, role string, normaliser string")


def fact_kinds_table(spark: SparkSession, own: str = OWN) -> DataFrame:
    return spark.createDataFrame(fact_kinds(own), "predicate string, kind string, historical boolean")


def card_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(card_properties(), "property string, concept string, service string")


def canonical(c: Column) -> Column:
    """An IRI with the http form of the schema namespace as https, trimmed."""
    return F.regexp_replace(F.trim(c), "^http://schema\\.org/", PREFIXES["schema"])


def is_contact_type(c: Column) -> Column:
    return canonical(c).isin(*entity_types())


def looked_up(c: Column, known: dict[str, str]) -> Column:
    """The value of a small fixed map, null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), c)


def service_of(c: Column) -> Column:
    """The service homepage that a value like `skype:name` names before its colon; '' where it names none."""
    scheme = F.lower(F.regexp_extract(c, "^([^:]*):", 1))
    return F.coalesce(looked_up(scheme, SERVICES), F.lit(""))


def closed_on(c: Column) -> Column:
    """The day on which a service closed, null where none is known."""
    return looked_up(c, CLOSED)
