"""Column functions over facts, texts and vectors. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlog.functions.constants import EDGE_TYPES, LABELS, STOPWORDS, SUBJECT_NAMESPACES


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_string(x) -> Column:
    """A JSON string as the log's writer escapes it: besides the JSON escapes, < > & and U+2028/9 are \\u escapes."""
    out = F.regexp_replace(F.to_json(F.struct(col(x).alias("s"))), r'(?s)^\{"s":(.*)\}$', "$1")
    for raw, escaped in (("<", "\\\\u003c"), (">", "\\\\u003e"), ("&", "\\\\u0026"), (" ", "\\\\u2028"), (" ", "\\\\u2029")):
        out = F.regexp_replace(out, raw, escaped)
    return out


def canonical_body(prefix: str = "") -> Column:
    """The canonical JSON of a fact without its checksum: fixed key order, no white space, `v` as it is (null if missing)."""
    parts = [F.lit("{")]
    for i, name in enumerate(["tx", "ts", "actor", "op", "e", "a", "v", "src", "invocation_id"]):
        c = F.col(prefix + name)
        parts += [F.lit(("," if i else "") + f'"{name}":'), F.when(c.isNull() | (c == ""), "null").otherwise(c) if name == "v" else json_string(F.coalesce(c, F.lit("")))]
    return F.concat(*parts, F.lit("}"))


def sealed_line() -> Column:
    """The JSON line of a sealed fact."""
    return F.concat(F.expr("left(body, length(body) - 1)"), F.lit(',"checksum":"'), F.col("checksum"), F.lit('"}'))


def tx_day(tx) -> Column:
    """The UTC day of a time-ordered id, from its first ten base-32 digits; partitions facts so that ranges of tx prune."""
    digits = F.translate(F.substring(col(tx), 1, 10), "ABCDEFGHJKMNPQRSTVWXYZ", "ABCDEFGHIJKLMNOPQRSTUV")
    return F.to_date(F.timestamp_millis(F.conv(digits, 32, 10).cast("long")))


def label_of(e) -> Column:
    """The label that the prefix of an entity id names."""
    prefix = F.substring_index(col(e), ":", 1)
    out = F.lit("Entity")
    for name, label in LABELS.items():
        out = F.when(col(e).contains(":") & (prefix == name), label).otherwise(out)
    return out


def edge_type(a) -> Column:
    """The edge type of an attribute, ignoring case; null if it is a plain attribute. `link.<TYPE>` is an edge of that type."""
    name = F.lower(col(a))
    out = F.when(name.startswith("link."), F.expr("upper(substring(a, 6))") if a == "a" else F.upper(F.regexp_replace(name, "^link\\.", "")))
    out = out.when(name == "subject.alias_of", "ALIAS_OF")
    for k, v in EDGE_TYPES.items():
        out = out.when(name == k, v)
    return out


def property_name(a) -> Column:
    """An attribute as a graph property: what is not a letter, digit or _ becomes _; a leading digit gets a _ before it."""
    clean = F.regexp_replace(F.regexp_replace(col(a), "[^A-Za-z0-9_]", "_"), "^([0-9])", "_$1")
    return F.when(col(a) == "", "value").otherwise(clean)


def vector_property_name(a) -> Column:
    """An attribute as a property of the vector store: the first character must be a letter, else p_ is put before it."""
    clean = F.regexp_replace(F.regexp_replace(col(a), "[^A-Za-z0-9_]", "_"), "^([0-9])", "p_$1")
    return F.when(col(a) == "", "value").when(F.substring(col(a), 1, 1) == "_", F.concat(F.lit("p_"), clean)).otherwise(clean)


def decoded(v) -> tuple[Column, Column]:
    """(type, text) of a JSON value: whole numbers are bigint, other numbers double, arrays and objects stay JSON strings;
    null gives null; what is no JSON stays as it is, as a string."""
    parsed = F.try_parse_json(col(v))
    kind = F.schema_of_variant(parsed)
    number = F.try_variant_get(parsed, "$", "double")
    whole = number == F.floor(number)
    type_ = (
        F.when(parsed.isNull(), F.when(col(v).isNotNull() & (col(v) != ""), "string"))
        .when(kind == "VOID", F.lit(None))
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), "json")
        .when(whole, "bigint")
        .otherwise("double")
    )
    text = (
        F.when(parsed.isNull(), F.when(col(v) != "", col(v)))
        .when(kind == "VOID", F.lit(None))
        .when(kind.isin("BOOLEAN", "STRING"), F.try_variant_get(parsed, "$", "string"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(parsed))
        .when(whole, number.cast("bigint").cast("string"))
        .otherwise(number.cast("string"))
    )
    return type_, text


def object_id(e, prefix: str) -> Column:
    """A name-based UUID: SHA-1 of prefix and id, with the version (5) and variant bits set."""
    h = F.sha1(F.concat(F.lit(prefix), col(e)).cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def entropy(text) -> Column:
    """Shannon entropy of the UTF-8 bytes, in bits."""
    pairs = F.filter(F.split(F.hex(F.encode(col(text), "UTF-8")), r"(?<=\G..)"), lambda b: b != "")
    n = F.size(pairs)
    p = lambda b: F.size(F.filter(pairs, lambda x: x == b)) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(pairs), F.lit(0.0), lambda acc, b: acc - p(b) * F.log2(p(b)))).otherwise(0.0)


def concepts(text) -> Column:
    """The sorted distinct concept tokens of a text: runs of letters, digits and _, lower-cased, trimmed of -_, at least three
    bytes, not all digits, no stopword."""
    tokens = F.array_distinct(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{Nd}_]+"))
    trimmed = F.transform(tokens, lambda t: F.btrim(t, F.lit("-_")))
    kept = F.filter(trimmed, lambda t: (F.octet_length(t) >= 3) & (F.translate(t, "0123456789", "") != ""))
    return F.array_sort(F.array_except(kept, F.array(*[F.lit(w) for w in STOPWORDS])))


def cosine(a, b) -> Column:
    """Cosine in double precision; 0 for vectors of different or no length, or of norm zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(col(a), col(a))) * F.sqrt(dot(col(b), col(b)))
    return F.when((F.size(col(a)) == F.size(col(b))) & (F.size(col(a)) > 0) & (norm > 0), dot(col(a), col(b)) / norm).otherwise(0.0)


def membership_hash(ids) -> Column:
    """SHA-256 over the sorted ids, each after a NUL."""
    return F.sha2(F.array_join(F.transform(F.array_sort(col(ids)), lambda x: F.concat(F.lit("\0"), x)), "").cast("binary"), 256)


def subject_error(s) -> Column:
    """Null for a valid subject `namespace/local`, else the reason."""
    at = F.instr(col(s), "/")
    return F.when((at <= 1), "UNKNOWN_NAMESPACE").when(at == F.length(col(s)), "EMPTY_LOCAL_ID").when(~F.substring_index(col(s), "/", 1).isin(SUBJECT_NAMESPACES), "UNKNOWN_NAMESPACE")


def decayed(base, age_seconds, exponent: float = 0.5) -> Column:
    return col(base) * F.pow(1.0 + F.greatest(col(age_seconds), F.lit(0.0)), F.lit(-exponent))


def frame_slots(slots) -> Column:
    return F.map_keys(F.from_json(col(slots), "map<string,string>"))
