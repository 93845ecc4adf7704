"""Secret scan with corpus-wide ownership of each candidate.

Patterns propose candidates in every text.  Their hashes are then counted over
the whole corpus by distinct repositories and owners: a value that many owners
hold is a copied example, one that a single owner holds looks live.  Only SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.spans import joined, let, located, matches
from stratalog.llm.store import fresh, written

#: Kinds in the order of the report; those of BASE have fixed patterns.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "jwt", "pem")
_NAMES = r"(?:password|passwd|secret|token|api_?key)"
PATTERNS = {
    "assign": rf"(?i){_NAMES}[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "github": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+",
    "jwt": r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "pem": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
#: What stands before the value in a match of "assign".
_HEAD = rf"^(?i){_NAMES}[\"']?\x20*[:=]\x20*[\"']?"
#: Values that stand for a value.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change_?me|your_?|x{6}|\.{3}|0{8}|12345678"


def _value(kind: str, match: Column) -> Column:
    return F.regexp_replace(match, _HEAD, "") if kind == "assign" else match


def _valid(kind: str, match: Column) -> Column:
    return {"assign": lambda: F.length(_value(kind, match)) >= 8, "access": lambda: F.length(match) >= 16}.get(kind, lambda: F.lit(True))()


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, rank, kind, end, hash, placeholder).

    Ordered by start, then by the order of ``KINDS``; start and end count code
    points, the end is exclusive; ``hash`` is the SHA-256 of the secret value,
    which itself is not kept.  A null text is taken as empty; rows stay as they
    are; a column ``secrets`` that was there before is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    gates = {"assign": whole.rlike(rf"(?i){_NAMES}"), "access": whole.contains("AKIA"), "hex": whole.rlike("[0-9a-f]{32}"), "github": whole.rlike("gh[pousr]_"), "jwt": whole.contains("eyJ"), "pem": whole.contains("PRIVATE KEY-----")}
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,hash:string,placeholder:boolean>>")

    def kept(rank: int, kind: str) -> Column:
        def one(s: Column) -> Column:
            value = _value(kind, s["value"])
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.sha2(value, 256).alias("hash"), value.rlike(PLACEHOLDER).alias("placeholder"))

        def spans(found: Column) -> Column:
            return F.when(F.size(found) > 0, F.transform(F.filter(located(whole, PATTERNS[kind], found), lambda s: _valid(kind, s["value"])), one)).otherwise(none)

        return let(matches(whole, PATTERNS[kind], gates[kind]), spans)

    rest = [c for c in docs.columns if c != "secrets"]
    return docs.select(*rest, F.array_sort(F.concat(*[kept(r, k) for r, k in enumerate(KINDS)])).alias("secrets"))


def ownership(found: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """(hash, n_repositories, n_owners, n_spans) over all candidates.

    Counting goes by (hash, repository, owner) first, with partial sums in each
    task, so a value that is everywhere is a few rows a task.
    """
    one = found.select(F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.explode("secrets").alias("s"))
    pairs = one.groupBy(F.col("s.hash").alias("hash"), "repository", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n_spans"))


def judged(found: DataFrame, repository: str = "source", owner: str = "source", copied_from: int = 3) -> DataFrame:
    """``found`` with ``n_live`` and ``n_copied``: spans by whose corpus-wide ownership they are.

    A candidate held by ``copied_from`` or more owners, or a placeholder, is a
    copied example; others look live.  Rows without candidates never move; the
    others are exploded, joined with the counts by hash (both sides by
    exchange, so that a hot hash can be split) and summed by row.
    """
    row = fresh(found, "__row")
    table = written(found.withColumn(row, F.monotonically_increasing_id()), "secrets")
    held = written(ownership(table, repository, owner), "ownership")
    rest = [c for c in found.columns if c not in ("n_live", "n_copied")]
    one = table.where(F.size("secrets") > 0).select(row, F.explode("secrets").alias("s")).select(row, F.col("s.hash").alias("hash"), F.col("s.placeholder").alias("placeholder"))
    copied = (F.col("n_owners") >= copied_from) | F.col("placeholder")
    sums = one.join(held, "hash").groupBy(row).agg(F.count_if(~copied).alias("n_live"), F.count_if(copied).alias("n_copied"))
    out = table.select(*rest, row).join(sums, row, "left")
    return out.select(*rest, F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = judged(find(docs).select("doc_id", "source", "secrets"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        "n_live",
        "n_copied",
    )


def _sql() -> str:
    """The same in DuckDB: plain patterns, positions from running lengths of gaps and matches."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pattern = {
        "assign": rf"(?i){_NAMES}[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
        "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        "pem": PATTERNS["pem"],
    }
    value = {"assign": f"regexp_replace(v, {quoted('^' + pattern['assign'].removesuffix('[A-Za-z0-9+/_.=-]+'))}, '')"}
    valid = {"assign": f"length({value['assign']}) >= 8", "access": "length(v) >= 16", "hex": "length(v) >= 32"}
    parts = []
    for rank, kind in enumerate(KINDS):
        p = quoted(pattern[kind])
        parts.append(f"""select doc_id, source, {rank} as rank, '{kind}' as kind, s, s + length(v) as e, {value.get(kind, 'v')} as x from (
  select doc_id, source, v, sum(length(g) + length(v)) over (partition by doc_id order by i) - length(v) as s from (
    select doc_id, source, unnest(f) as v, unnest(string_split_regex(t, {p})[1:len(f)]) as g, unnest(range(1, len(f) + 1)) as i from (select doc_id, source, t, regexp_extract_all(t, {p}) as f from d)))
  where {valid.get(kind, 'true')}""")
    counts = ", ".join(f"cast(coalesce(n_{k}, 0) as bigint) as n_{k}" for k in BASE)
    sums = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)
    one = "kind || ':' || cast(s as bigint) || ':' || cast(e as bigint)"
    return f"""with d as (select doc_id, source, coalesce(text, '') as t from documents), s as ({' union all '.join(parts)}),
o as (select x, count(distinct source) as owners from s group by x),
j as (select s.*, owners >= 3 or regexp_matches(s.x, {quoted(PLACEHOLDER)}) as copied from s join o on o.x = s.x),
y as (select doc_id, {sums}, string_agg({one}, ',' order by s, rank) filter (where rank < {len(BASE)}) as base, string_agg({one}, ',' order by s, rank) as spans, count(*) filter (where not copied) as n_live, count(*) filter (where copied) as n_copied from j group by doc_id)
select d.doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, cast(coalesce(n_live, 0) as bigint) as n_live, cast(coalesce(n_copied, 0) as bigint) as n_copied from d left join y on y.doc_id = d.doc_id"""


SQL = _sql()
