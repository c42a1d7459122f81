"""Secret scans that link the parts of a credential.

Three kinds are spans on their own (base spans): assignments, access
identifiers and long hexadecimal strings. A credential has more than one part,
though, and its other parts look like nothing alone: a 40-character key, a
service endpoint. Those *weak* candidates are reported only where a
complementary part lies within ``SCOPE`` code points in the same text: a key
next to an access identifier or endpoint, an endpoint next to an identifier, a
key or an assigned secret. Parts are joined by interval: each is dealt to the
scope-wide bins it can reach, parts of a text meet in a bin by an equality
semi-join, and the distance is verified. A bin is as wide as the scope, so it
holds a bounded number of parts.

Scanning is done by expressions without a shuffle. Only the parts found in
texts with weak candidates and complements go through the interval join, keyed
by the text's digest; the linked candidates come back by a join that moves no
text where they are few.

Only DataFrame expressions are used: no Python code runs on executors.

Defined results for odd input: a null text is empty; empty texts have no spans,
empty ``spans`` and the digest of the empty string; texts of any length are
scanned whole; equal texts have equal spans; repeated rows are all returned; an
empty table gives an empty result; extra columns pass through ``redact`` and
are ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistra.llm.common import cut, table, whole_text

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
#: Runs shorter than 24 are no base match; leaving them out of the pattern finds the same spans.
HEX = "[0-9a-f]{24,}"
#: Weak candidates, kept only when linked: mixed 40-character keys, service endpoints.
KEY = "(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = "(?:https?|s3|wss?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%/?&=+-]{4,}"
#: What a key or a long hexadecimal string begins with.
RUN = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24}"
#: Which parts complete which weak candidate.
COMPLETES = {"key": ("access", "endpoint"), "endpoint": ("access", "key", "assign", "hex")}
#: Code points between parts that still belong to one credential.
SCOPE = 400
#: Texts with linked candidates that are told to all tasks; more are joined.
TOLD = 20_000

KINDS = ("assign", "access", "hex", "key", "endpoint")
BASE = KINDS[:3]
SPANS = "array<struct<kind:string,start:int,end:int>>"
MASK = "<secret>"


def _none() -> Column:
    return F.array().cast(SPANS)


def _spans(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """The leftmost non-overlapping matches, in code points.

    Matches and the pieces between them alternate, so the running sum of their
    lengths gives the places. Matches whose ``group`` is shorter than ``least``
    are dropped.
    """
    sizes = lambda parts: F.transform(parts, lambda x: F.length(x))
    found = sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    inner = sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    gaps = sizes(F.split(text, pattern, -1))
    each = F.arrays_zip(found.alias("n"), inner.alias("k"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["n"]
        span = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["k"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).cast(SPANS).alias("out"))

    return F.aggregate(each, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda acc: acc["out"])


def _if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(_none())


def _once(value: Column, test: Callable[[Column], Column]) -> Column:
    """``test`` of a value that is computed once."""
    return F.exists(F.array(value), test)


def find(text: Column, kinds: tuple[str, ...] = KINDS) -> dict[str, Column]:
    """Spans by kind; cheap tests go before each pattern."""
    named = _once(F.lower(text), lambda t: t.contains("passw") | t.contains("secret") | t.contains("token") | t.contains("apikey") | t.contains("api_key"))
    run = text.rlike(RUN)  # a hexadecimal string and a key are both parts of such a run
    all_kinds = {
        "assign": lambda: _if(named & text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), _spans(text, ASSIGN, "assign", 6, 2)),
        "access": lambda: _if(text.contains("AKIA"), _spans(text, ACCESS, "access", 20)),
        "hex": lambda: _if(run & text.rlike("[0-9a-f]{24}"), _spans(text, HEX, "hex")),
        "key": lambda: _if(run & text.rlike("[A-Za-z0-9+/]{40}"), _spans(text, KEY, "key")),
        "endpoint": lambda: _if(text.contains("://"), _spans(text, ENDPOINT, "endpoint")),
    }
    return {k: all_kinds[k]() for k in kinds}


def ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.lit(list(KINDS)), s["kind"]).cast("int")
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(SPANS)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _may_link(by_kind: dict[str, Column]) -> Column:
    """Whether a text has a weak candidate and some part that could complete it."""
    has = lambda k: F.size(by_kind[k]) > 0
    out = F.lit(False)
    for weak, parts in COMPLETES.items():
        other = F.lit(False)
        for p in parts:
            other = other | has(p)
        out = out | (has(weak) & other)
    return out


def linked(texts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """texts(__digest, one array of spans per kind) -> (__digest, __weak): the candidates that have a complement."""
    bins = lambda low, high: F.sequence(F.floor(low / scope).cast("int"), F.floor(high / scope).cast("int"))

    def parts(kinds: tuple[str, ...]) -> DataFrame:
        return texts.select("__digest", F.explode(F.concat(*(F.col(f"__{k}") for k in kinds))).alias("s")).select("__digest", "s.kind", "s.start", "s.end")

    out = None
    for weak, others in COMPLETES.items():
        c = parts((weak,)).withColumn("bin", F.explode(bins(F.col("start"), F.col("end"))))
        p = parts(others).select(F.col("__digest").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
        p = p.withColumn("b", F.explode(bins(F.col("s") - scope, F.col("e") + scope)))
        near = (c["__digest"] == p["k"]) & (c["bin"] == p["b"]) & (p["s"] - c["end"] <= scope) & (c["start"] - p["e"] <= scope)
        met = c.join(p, near, "left_semi").select("__digest", F.struct("kind", "start", "end").alias("s")).distinct()
        out = met if out is None else out.union(met)
    return out.groupBy("__digest").agg(F.collect_list("s").cast(SPANS).alias("__weak"))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Adds ``base`` and ``spans``, arrays of (kind, start, end), to every row.

    Texts that could have a weak candidate are looked at first, and the linked
    candidates of all are written; every row is then scanned once.
    """
    body = whole_text(text)
    helpers = [f"__{k}" for k in KINDS]
    kinds = {k: F.col(f"__{k}") for k in KINDS}
    may = _may_link(kinds)
    weak_ones = docs.select(body.alias("__body")).filter(F.col("__body").contains("://") | F.col("__body").rlike(RUN))
    parts = weak_ones.select(F.md5("__body").alias("__digest"), *(c.alias(f"__{k}") for k, c in find(F.col("__body")).items()))
    weak = cut(linked(cut(parts.filter(may)).dropDuplicates(["__digest"]), scope))
    n = weak.count()

    def spans(found: DataFrame) -> DataFrame:
        return found.withColumn("spans", ordered(F.concat("base", F.coalesce("__weak", _none())))).drop("__digest", "__weak")

    if not n:  # no candidate of the table is linked
        found = docs.withColumns({f"__{k}": c for k, c in find(body, BASE).items()})
        return found.withColumn("base", ordered(F.concat(*(kinds[k] for k in BASE)))).withColumn("spans", F.col("base")).drop(*helpers)
    found = docs.withColumns({f"__{k}": c for k, c in find(body).items()})
    found = found.withColumn("base", ordered(F.concat(*(kinds[k] for k in BASE)))).withColumn("__digest", F.when(may, F.md5(body))).drop(*helpers)
    if n <= TOLD:
        return spans(found.join(F.broadcast(weak), "__digest", "left"))
    still = found.filter("__digest is null").withColumn("spans", F.col("base")).drop("__digest")
    return still.unionByName(spans(found.filter("__digest is not null").join(weak, "__digest", "left")))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, every span of the text replaced by a mask; overlapping spans become one."""
    names = docs.columns
    body = whole_text(text)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    clean = F.aggregate("spans", first, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    own = {c: f"__own_{c}" for c in ("base", "spans") if c in names}
    masked = scan(docs.withColumnsRenamed(own), text).withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text)))
    return masked.select(*(F.col(own.get(c, c)).alias(c) for c in names))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *map(n, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


#: The same result by DuckDB, from the contract's patterns and the rule for links; what Java's pattern of a key says by looking
#: around is said by whole runs of its characters.
OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
runs as (
    select doc_id, 'assign' as kind, 0 as place, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) as found,
        regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) as inside,
        string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') as gaps from d
    union all select doc_id, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), string_split_regex(t, 'AKIA[A-Z0-9]+') from d
    union all select doc_id, 'hex', 2, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0), string_split_regex(t, '[0-9a-f]+') from d
    union all select doc_id, 'key', 3, regexp_extract_all(t, '[A-Za-z0-9+/=_-]+', 0), regexp_extract_all(t, '[A-Za-z0-9+/=_-]+', 0), string_split_regex(t, '[A-Za-z0-9+/=_-]+') from d
    union all select doc_id, 'endpoint', 4, regexp_extract_all(t, '(?:https?|s3|wss?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%/?&=+-]{4,}', 0),
        regexp_extract_all(t, '(?:https?|s3|wss?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%/?&=+-]{4,}', 0),
        string_split_regex(t, '(?:https?|s3|wss?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%/?&=+-]{4,}') from d),
each as (
    select doc_id, kind, place, unnest(found) as x, unnest(inside) as g, unnest(gaps[1:len(found)]) as gap, unnest(range(1, len(found) + 1)) as i
    from runs where len(found) > 0),
placed as (
    select *, sum(length(gap) + length(x)) over (partition by doc_id, kind order by i) as finish from each),
parts as (
    select doc_id, kind, place, finish - length(x) as start, finish from placed
    where (kind = 'assign' and length(g) >= 6) or (kind = 'access' and length(x) >= 20) or (kind = 'hex' and length(x) >= 24) or kind = 'endpoint'
        or (kind = 'key' and length(x) = 40 and regexp_full_match(x, '[A-Za-z0-9+/]+') and regexp_matches(x, '[A-Z]') and regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9]'))),
spans as (
    select * from parts where place < 3
    union all
    select c.* from parts c where c.place >= 3 and exists (
        select 1 from parts o where o.doc_id = c.doc_id and o.start - c.finish <= 400 and c.start - o.finish <= 400
            and ((c.kind = 'key' and o.kind in ('access', 'endpoint')) or (c.kind = 'endpoint' and o.kind in ('access', 'key', 'assign', 'hex'))))),
told as (
    select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || start::bigint || ':' || finish::bigint, ',' order by start, place, finish) filter (place < 3) as base,
        string_agg(kind || ':' || start::bigint || ':' || finish::bigint, ',' order by start, place, finish) as spans
    from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told on told.doc_id = d.doc_id
"""
