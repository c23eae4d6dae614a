"""String functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits, or one other character that is not white space.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]|_|,"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_tokens(text) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def _ends(x: Column, *tails: str) -> Column:
    out = x.endswith(tails[0])
    for t in tails[1:]:
        out |= x.endswith(t)
    return out


def _but(x: Column, n: int) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - n)


def normalize_token(token) -> Column:
    """Plural stripping, case-sensitive."""
    t = _c(token)
    return (
        F.when(~t.endswith("s"), t)
        .when(t.endswith("viruses"), _but(t, 2))
        .when(t.endswith("ies") & ~_ends(t, "eies", "aies"), F.concat(_but(t, 3), F.lit("y")))
        .when(t.endswith("es") & ~_ends(t, "aes", "ees", "oes"), F.when(t.endswith("sses"), _but(t, 2)).otherwise(_but(t, 1)))
        .when(_ends(t, "us", "ss"), t)
        .otherwise(_but(t, 1))
    )


def normalize_text(text) -> Column:
    """Normalised tokens joined by one space."""
    return F.array_join(F.transform(split_tokens(text), normalize_token), " ")


#: What separates words: Unicode's white space and the information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def casefold(text) -> Column:
    """Full case folding out of case mappings: sharp s is ss, every sigma one letter; the dotless i stays."""
    x = F.replace(F.lower(_c(text)), F.lit("\u0131"), F.lit("\ue131"))
    # the step between upper and lower also keeps the optimizer from dropping the first
    x = F.translate(F.upper(x), "\ue131", "\u0131")
    return F.translate(F.lower(x), "\u03c2", "\u03c3")


def _single_spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACE, " "))


def fold(text) -> Column:
    """Case-folded, with white space runs as single spaces."""
    return _single_spaced(casefold(F.coalesce(_c(text), F.lit(""))))


def jaccard_tokens(text) -> Column:
    """Distinct words of the folded text, cut at white space only."""
    return F.array_remove(F.array_distinct(F.split(fold(text), " ")), "")


def token_jaccard(left, right) -> Column:
    """Shared share of two token sets; 0 if either is empty."""
    a, b = jaccard_tokens(left), jaccard_tokens(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def has_parenthetical_relation(left, right) -> Column:
    """1.0 if either text stands in innermost parentheses of the other; empty parentheses hold the empty text."""

    def inside(outer: Column, inner: Column) -> Column:
        return F.exists(F.regexp_extract_all(F.coalesce(outer, F.lit("")), F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: fold(x) == fold(inner))

    return F.when(inside(_c(left), _c(right)) | inside(_c(right), _c(left)), F.lit(1.0)).otherwise(F.lit(0.0))


def abbreviation_key(text) -> Column:
    """Short form without dashes and white space; case stays."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)[\-\u2010-\u2014\u2212\s\x1c-\x1f]", "")


def abbreviation_variants(key) -> Column:
    """The key, and the key with its final s removed or added; a lone s gets one more."""
    k = _c(key)
    other = F.when(k.endswith("s") & (F.length(k) > 1), _but(k, 1)).otherwise(F.concat(k, F.lit("s")))
    return F.filter(F.array_distinct(F.array(k, other)), lambda x: x != "")


def abbreviation_threshold(key) -> Column:
    n = F.length(_c(key))
    return F.when(n <= 4, F.lit(1.0)).when(n <= 7, F.lit(0.95)).otherwise(F.lit(0.90))


def is_abbreviation_like(text) -> Column:
    t = F.trim(F.coalesce(_c(text), F.lit("")))
    key = abbreviation_key(t)
    short = (F.length(key) <= 12) & ~t.contains(" ")
    return (F.length(key) > 1) & (t.rlike(r"\p{IsUppercase}") | t.rlike(r"[\p{Nd}²³¹]") | t.rlike(r"[+/\-]") | short)


def normalize_mention(text) -> Column:
    """Lower case (not folded: sharp s stays), single spaces, no punctuation at the edges."""
    x = _single_spaced(F.lower(F.coalesce(_c(text), F.lit(""))))
    return F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def clean_identifier(text) -> Column:
    return F.trim(F.replace(F.replace(F.trim(_c(text)), F.lit("(skos:exact)"), F.lit("")), F.lit("(skos:related)"), F.lit("")))


def split_identifiers(text) -> Column:
    """All identifiers of a field: no placeholders."""
    parts = F.transform(F.split(clean_identifier(F.coalesce(_c(text), F.lit(""))), "[;,]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (x != "-") & (F.lower(x) != "none"))


def first_identifier(text) -> Column:
    return F.get(split_identifiers(text), F.lit(0))


def concept_id(text) -> Column:
    """Ontology identifiers with an upper-case prefix and a colon."""
    return F.regexp_replace(F.trim(_c(text)), r"(?i)^cl[_:]", "CL:")


def obo_unescape(text) -> Column:
    x = F.replace(_c(text), F.lit('\\"'), F.lit('"'))
    return F.trim(F.replace(x, F.lit("\\n"), F.lit("\n")))


def quoted(text) -> Column:
    """Content of the first quoted string, escapes resolved."""
    return obo_unescape(F.regexp_extract(_c(text), r'"((?:[^"\\]|\\.)*)"', 1))


def as_list(text) -> Column:
    """Parts of a list field: by |, else by ;, else the field itself; blanks dropped."""
    t = F.coalesce(_c(text), F.lit(""))
    parts = F.when(t.contains("|"), F.split(t, r"\|")).otherwise(F.split(t, ";"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def first_nonempty(*columns) -> Column:
    return F.coalesce(*[F.nullif(F.trim(_c(c)), F.lit("")) for c in columns])


def safe_int(text, default: int | None = 0) -> Column:
    got = F.trim(_c(text)).try_cast("int")
    return got if default is None else F.coalesce(got, F.lit(default))


def safe_double(text) -> Column:
    return F.trim(_c(text)).try_cast("double")


def spans_overlap(s1, e1, s2, e2) -> Column:
    return F.greatest(_c(s1), _c(s2)) < F.least(_c(e1), _c(e2))


def overlap_length(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def byte_offset(text, position) -> Column:
    """UTF-8 byte offset of a code point offset."""
    return F.octet_length(F.substring(_c(text), F.lit(1), _c(position).cast("int") if not isinstance(position, int) else F.lit(position)))


def score_text(score, digits: int = 8) -> Column:
    return F.format_string(f"%.{digits}f", _c(score).cast("double"))


def significant(number) -> Column:
    """Six significant digits without trailing zeros, and an exponent under 1e-4 and from a million on."""
    x = _c(number).cast("double")
    e = F.format_string("%.5e", x)
    power = F.regexp_extract(e, r"e([+-]\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(e.try_cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(e, r"0+(e[+-]\d+)$", "$1"), r"\.(e[+-]\d+)$", "$1")
    finite = F.when(x == 0, F.lit("0")).when((power >= -4) & (power < 6), plain).otherwise(short)
    return F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(finite)


def file_safe(text) -> Column:
    return F.regexp_replace(F.trim(_c(text)), r"[^A-Za-z0-9._-]+", "_")
