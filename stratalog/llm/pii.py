"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Only SQL functions are used.  Patterns use possessive quantifiers and look
behind for the start of a run, so that a scan is linear in the text and does
not nest as deep as a text is long; they match what the plain patterns match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.spans import digits, joined, let, located, matches, replaced
from stratalog.llm.store import aside

#: Kinds in the order of the report; those of BASE have fixed patterns.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that, shortly before a span, speak for its kind.
CONTEXT = {
    "email": r"e-?mail|contact|mailto|write to|reply|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|peer",
    "card": r"card|visa|master ?card|amex|credit|debit|payment|tarjeta|carte|karte",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|fax|cell|whatsapp|telefon|tel[eé]fono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|tax id|taxpayer",
}
#: Score without context, and what context adds.
SCORE = {"email": (0.9, 0.1), "ip": (0.5, 0.3), "card": (0.7, 0.3), "phone": (0.6, 0.3), "iban": (0.9, 0.1), "ssn": (0.3, 0.5)}
WINDOW = 48
_OCTET = r"(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}))"


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(code: Column) -> Column:
    """Whether an account number (its spaces left out) passes the mod-97 check."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    n = F.length(turned)
    return F.when((n >= 15) & (n <= 34), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) == 1).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda: luhn(digits(value)),
        "phone": lambda: (n >= 9) & (n <= 15),
        "iban": lambda: mod97(value),
        "ssn": lambda: ~value.rlike(r"^(?:000|666|9..)|-00-|-0000$"),
    }[kind]()


def find(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``pii``: an array of (start, rank, kind, end, value, score).

    Spans are ordered by start, then by the order of ``KINDS``; start and end
    count code points, the end is exclusive.  Spans of the kinds in ``BASE``
    that pass their check always stay; others need a score of ``least``, so a
    bare number that only looks like an identity number needs a context word.
    A null text is taken as empty; rows stay as they are; a column ``pii``
    that was there before is replaced.  Nothing is shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    gates = {"email": whole.contains("@"), "phone": whole.contains("+"), "ssn": whole.contains("-") & whole.rlike("[0-9]{3}-"), "iban": whole.rlike("[A-Z]{2}[0-9]{2}")}
    numbered = whole.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,score:double>>")

    def scored(rank: int, kind: str) -> Column:
        low, more = SCORE[kind]

        def one(s: Column) -> Column:
            near = F.lower(s["before"]).rlike(CONTEXT[kind])
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), (F.lit(low) + F.when(near, more).otherwise(0.0)).alias("score"))

        def spans(found: Column) -> Column:
            out = F.transform(F.filter(located(whole, PATTERNS[kind], found, WINDOW), lambda s: _valid(kind, s["value"])), one)
            return F.when(F.size(found) > 0, out if kind in BASE else F.filter(out, lambda s: s["score"] >= least)).otherwise(none)

        return let(matches(whole, PATTERNS[kind], gates.get(kind, numbered)), spans)

    rest = [c for c in docs.columns if c != "pii"]
    return docs.select(*rest, F.array_sort(F.concat(*[scored(r, k) for r, k in enumerate(KINDS)])).alias("pii"))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with each personal span replaced by its kind in brackets.

    Where spans overlap, the first one's kind stands for the covered stretch.
    Other texts, null ones too, stay as they are; ``n_chars``, if there,
    follows the text.
    """
    moved, own = aside(docs, ["pii"])
    found = find(moved)
    spans = F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    clean = replaced(F.col("text"), spans)
    changed = F.size("pii") > 0
    out = found.withColumn("text", F.when(changed, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        *[count(k) for k in KINDS if k not in BASE],
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def _sql() -> str:
    """The same in DuckDB: plain patterns, positions from running lengths of gaps and matches."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    digits_of = "regexp_replace(v, '[^0-9]', '', 'g')"
    pattern = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": "[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
        "ssn": "[0-9-]+",
    }
    turned = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast('0' || left(ltrim(x, '0'), 3) as integer) > 255)) = 0",
        "card": f"length({digits_of}) between 12 and 19 and list_sum(list_transform(range(1, length({digits_of}) + 1), lambda i: case when (length({digits_of}) - i) % 2 = 1 then (2 * cast(substr({digits_of}, i, 1) as integer)) // 10 + (2 * cast(substr({digits_of}, i, 1) as integer)) % 10 else cast(substr({digits_of}, i, 1) as integer) end)) % 10 = 0",
        "phone": f"length({digits_of}) between 9 and 15",
        "iban": f"length({turned}) between 15 and 34 and list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda i: ascii(substr({turned}, i, 1)))), lambda a, c: case when c < 58 then (a * 10 + c - 48) % 97 else (a * 100 + c - 55) % 97 end) = 1",
        "ssn": "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}') and not regexp_matches(v, '^(?:000|666|9..)|-00-|-0000$')",
    }
    parts = []
    for rank, kind in enumerate(KINDS):
        p = quoted(pattern[kind])
        low, more = SCORE[kind]
        parts.append(f"""select doc_id, {rank} as rank, '{kind}' as kind, s, s + length(v) as e, score from (
  select doc_id, v, s, {low} + case when regexp_matches(lower(substr(t, greatest(s - {WINDOW}, 0) + 1, s - greatest(s - {WINDOW}, 0))), {quoted(CONTEXT[kind])}) then {more} else 0 end as score from (
    select doc_id, t, v, cast(sum(length(g) + length(v)) over (partition by doc_id order by i) - length(v) as bigint) as s from (
      select doc_id, t, unnest(f) as v, unnest(string_split_regex(t, {p})[1:len(f)]) as g, unnest(range(1, len(f) + 1)) as i from (select doc_id, t, regexp_extract_all(t, {p}) as f from d)))
  where {valid[kind]}) where {rank} < {len(BASE)} or score >= 0.5""")
    counts = ", ".join(f"cast(coalesce(n_{k}, 0) as bigint) as n_{k}" for k in KINDS)
    sums = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in KINDS)
    one = "kind || ':' || cast(s as bigint) || ':' || cast(e as bigint)"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), s as ({' union all '.join(parts)}),
x as (select doc_id, {sums}, string_agg({one}, ',' order by s, rank) filter (where rank < {len(BASE)}) as base, string_agg({one}, ',' order by s, rank) as spans, string_agg(printf('%.2f', cast(score as double)), ',' order by s, rank) as scores from s group by doc_id)
select d.doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores from d left join x on x.doc_id = d.doc_id"""


SQL = _sql()
