"""Code text and type strings, and JSON fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.tables import CODE_OPERATORS, KEYWORDS

# Names of comment types and statuses.
COMMENT_TYPES = ("note", "info", "question", "answer", "todo", "finding_lead", "dev_technical", "dev_documentation")
COMMENT_STATUSES = ("active", "hidden", "resolved", "unanswered", "answered", "unconfirmed", "confirmed", "rejected")

_OPERATOR = "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in op) for op in CODE_OPERATORS)
_TOKEN = rf"[A-Za-z_$][A-Za-z0-9_$]*|{_OPERATOR}|[^A-Za-z_$]"


def comment_type_of(c: Column) -> Column:
    """A comment type by its name; unknown ones are null."""
    return F.when(c.isin(*COMMENT_TYPES), c)


def comment_status_of(c: Column) -> Column:
    """A status by its name; unknown ones are active."""
    return F.when(c.isin(*COMMENT_STATUSES), c).otherwise("active")


def first_status(comment_type: Column) -> Column:
    """The status that a new comment has: questions are unanswered, leads unconfirmed."""
    return F.when(comment_type == "question", "unanswered").when(comment_type == "finding_lead", "unconfirmed").otherwise("active")


def attached_type(c: Column) -> Column:
    """The type that a library function is attached to, from a type identifier: a contract's name, else the type as it stands; null without one."""
    inner = F.regexp_extract(c, r"attached_to\$_t_(.*?)_\$", 1)
    whole = F.regexp_extract(c, r"attached_to\$_t_contract\$_(.*?)_\$", 1)
    found = F.when(inner.startswith("contract$_"), F.when(whole != "", whole).otherwise(F.expr("null"))).otherwise(inner)
    return F.when(c.rlike(r"attached_to\$_t_.*?_\$"), F.when(inner == "contract$", whole).otherwise(found))


def parse_type(c: Column) -> Column:
    """struct<base, bits, dims, key, value>: a type string in parts.

    base is bool, address, int, uint, bytes, string, mapping, function or user;
    bits is the width of numbers (256 if none) and the length of fixed bytes;
    dims counts the brackets of arrays; key and value are a mapping's types.
    """
    core = F.regexp_replace(F.trim(c), r"(\[[^\]]*\])+$", "")
    dims = F.when(core.startswith("mapping"), F.lit(0)).otherwise(F.size(F.regexp_extract_all(F.regexp_extract(F.trim(c), r"((?:\[[^\]]*\])*)$", 1), F.lit(r"\["), 0)))
    base = (
        F.when(core.startswith("mapping("), "mapping")
        .when(core.startswith("function"), "function")
        .when(core.rlike(r"^address( payable)?$"), "address")
        .when(core.isin("bool", "string"), core)
        .when(core.rlike(r"^u?int[0-9]*$"), F.regexp_extract(core, r"^(u?int)", 1))
        .when(core.rlike(r"^bytes[0-9]*$"), "bytes")
        .otherwise("user")
    )
    digits = F.regexp_extract(core, r"^(?:u?int|bytes)([0-9]+)$", 1)
    bits = F.when(base.isin("int", "uint", "bytes"), F.when(digits != "", digits.cast("int")).when(base != "bytes", 256))
    inside = r"^mapping\(\s*(.*?)\s*=>\s*(.*)\)$"
    part = lambda k: F.when(base == "mapping", F.trim(F.regexp_extract(core, inside, k)))
    return F.struct(base.alias("base"), bits.alias("bits"), dims.alias("dims"), part(1).alias("key"), part(2).alias("value"))


def code_tokens(c: Column) -> Column:
    """array<struct<class, value>> of code: operator, keyword, identifier or text, in order; operators are the longest that fit."""
    return F.transform(code_words(c), lambda x: F.struct(token_class(x).alias("class"), x.alias("value")))


def code_words(c: Column) -> Column:
    """array<string>: the values of code_tokens()."""
    return F.regexp_extract_all(c, F.lit(_TOKEN), 0)


def token_class(x: Column) -> Column:
    return F.when(x.isin(*CODE_OPERATORS), "operator").when(x.isin(*KEYWORDS), "keyword").when(x.rlike("^[A-Za-z_$]"), "identifier").otherwise("text")


def with_array_field(body: Column, name: str, values: Column) -> Column:
    """A JSON object with one more field, an array of strings."""
    field = F.concat(F.lit(f'"{name}":'), F.to_json(values))
    head = F.regexp_replace(F.trim(body), r"\}\s*$", "")
    return F.concat(head, F.when(F.trim(head) == "{", "").otherwise(","), field, F.lit("}"))


def array_field(body: Column, name: str) -> Column:
    """The strings of a JSON object's array field; none if it is missing or malformed."""
    return F.coalesce(F.from_json(F.get_json_object(body, f"$.{name}"), "array<string>"), F.expr("cast(array() as array<string>)"))


def breadcrumb(container: Column, component: Column, member: Column, name: Column) -> Column:
    """The names from the file to the topic, those that there are."""
    return F.filter(F.array(container, component, member, name), lambda x: x.isNotNull())


def opening(kind: Column) -> Column:
    """What opens a control-flow statement's body in the source view; null for others."""
    return F.when(kind.isin("IfStatement", "WhileStatement", "ForStatement", "TryStatement", "UncheckedBlock", "Block"), "{").when(kind.isin("FunctionCall", "TupleExpression"), "(").when(kind.isin("IndexAccess"), "[")


def closing(kind: Column) -> Column:
    return F.translate(opening(kind), "{([", "})]")
