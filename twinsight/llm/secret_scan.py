"""Secret scans by corpus-wide ownership, in DataFrame functions alone.

Every candidate is hashed; hashes are counted by the distinct owners and
repositories that hold them. A value that many owners share is a copied
example; one that belongs to few is a live-looking credential.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stage

#: Kinds in listed order, their patterns, the group that is the secret, and its least characters.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are whole, so the least length can stand in the pattern
)
#: Kinds that the method adds where the corpus shows that few own the value.
ADDED = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=,: \t\r\n]*-----END [A-Z ]*PRIVATE KEY-----", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 30),
    ("url_password", r"[a-z]{3,8}://[^ \t\r\n:/@]+:[^ \t\r\n:/@]{6,}@", 0, 12),
    ("owned", r"[A-Za-z0-9+/_.:-]{23,}[A-Za-z0-9+/_-]", 0, 24),
)
#: What a value of the kind "owned" must match, and what it must not: a host, a path or a file name.
OWNED_HAS = (r"[0-9][^0-9]*[0-9][^0-9]*[0-9]", r"[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]", r"[a-z][^a-z]*[a-z][^a-z]*[a-z]")
OWNED_LACKS = r"[.:]|/[^/]*/[^/]*/"
#: A value held by more owners, or more repositories, than these is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4

_KINDS = [k for k, *_ in BASE + ADDED]
_SPANS = "array<struct<start:int,order:int,end:int,from:int,byte_from:int,byte_end:int,value:string>>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _exponents(n: Column) -> Column:
    """0, 1, 2, ... up to the last whose power of two is at most n; none for n < 1."""
    return F.slice(F.sequence(F.lit(0), F.lit(30)), 1, F.when(n >= 1, F.floor(F.log2(n)).cast("int") + 1).otherwise(0))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array; each round adds what lies a power of two before, so n log n steps do."""

    def step(acc: Column, k: Column) -> Column:
        n, shift = F.size(acc), F.least(F.size(acc), _power(k))
        before = F.concat(F.array_repeat(F.lit(None), shift), F.slice(acc, 1, n - shift))
        return F.zip_with(acc, before, lambda x, y: F.when(y.isNull(), x).otherwise(add(x, y)))

    return bind(values, lambda v: F.aggregate(_exponents(F.size(v)), v, step))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.struct(F.char_length(x).alias("c"), F.octet_length(x).alias("b")))


def _plus(x: Column, y: Column) -> Column:
    return F.struct((x["c"] + y["c"]).alias("c"), (x["b"] + y["b"]).alias("b"))


def find(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, order, end, from, byte_from, byte_end, value>> of a kind's matches, by start.

    start, end and from, where the secret itself begins, are code points, end
    exclusive; the other two are bytes of the UTF-8. The text between matches
    and the matches alternate, so that running totals of their lengths are
    positions.
    """
    rx = F.lit(pattern)
    none = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"))

    def spans(known: Column) -> Column:
        sizes = known["sizes"]
        steps = F.zip_with(F.slice(known["gaps"], 1, F.size(sizes)), F.concat(F.array(none), F.slice(sizes, 1, F.size(sizes) - 1)), _plus)

        def one(value: Column, i: Column, starts: Column) -> Column:
            at, size = F.get(starts, i), F.get(sizes, i)
            end, byte_end = at["c"] + size["c"], at["b"] + size["b"]
            return F.struct(
                at["c"].alias("start"), F.lit(_KINDS.index(kind)).alias("order"), end.alias("end"), (end - F.char_length(value)).alias("from"),
                (byte_end - F.octet_length(value)).alias("byte_from"), byte_end.alias("byte_end"), value.alias("value"),
            )

        whole = bind(running(steps, _plus), lambda starts: F.transform(known["values"], lambda v, i: one(v, i, starts)))
        return F.filter(whole, lambda s: F.char_length(s["value"]) >= least)

    known = F.struct(
        _lengths(F.split(text, pattern, -1)).alias("gaps"), _lengths(F.regexp_extract_all(text, rx, 0)).alias("sizes"), F.regexp_extract_all(text, rx, group).alias("values")
    )
    return F.when(F.regexp_like(text, rx), bind(known, spans)).otherwise(F.array().cast(_SPANS))


def _meets(spans: Column, s: Column) -> Column:
    """Whether s shares a character with one of `spans`, which are sorted and apart: a binary search for the last that begins before s ends."""
    powers = F.reverse(F.transform(_exponents(F.size(spans)), _power))
    n = F.aggregate(powers, F.lit(0), lambda acc, p: F.when(F.get(spans, acc + p - 1)["start"] < s["end"], acc + p).otherwise(acc))
    return F.coalesce(F.get(spans, n - 1)["end"] > s["start"], F.lit(False))


def candidates(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """(doc_id, version, owner, repository, base, added) of each row; version is a hash of its text.

    Spans of the added kinds that share characters with a base span are left out.
    """
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), (F.col(owner) if repository is None else repository).cast("string").alias("repository"))
    kinds = [f"base_{k}" for k, *_ in BASE]
    owned = lambda s: reduce(lambda a, b: a & b, (F.regexp_like(s["value"], F.lit(x)) for x in OWNED_HAS)) & ~F.regexp_like(s["value"], F.lit(OWNED_LACKS))
    strong = lambda s: (s["order"] != _KINDS.index("owned")) | owned(s)
    free = lambda s: ~reduce(lambda a, b: a | b, (_meets(F.col(k), s) for k in kinds))
    spans = known.select(
        "doc_id", "owner", F.coalesce("repository", F.lit("")).alias("repository"), F.xxhash64("text").alias("version"),
        *(find(F.col("text"), *k).alias(name) for k, name in zip(BASE, kinds, strict=True)), F.concat(*(find(F.col("text"), *k) for k in ADDED)).alias("more"),
    )
    return spans.select("doc_id", "version", "owner", "repository", F.concat(*kinds).alias("base"), F.filter("more", lambda s: strong(s) & free(s)).alias("added"))


#: Fields of a span that say where it is.
PLACE = ("start", "order", "end", "from", "byte_from", "byte_end")


def scan(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """Spans of each row: (doc_id, version, base, added, live): base spans, the spans the method adds, and the live-looking ones of both.

    One row per input row. A null text is empty; a null owner counts as one
    owner. Candidates of a hot value are counted by owner before they meet.
    """
    rows = stage(candidates(docs, owner, repository), "candidates")
    tell = lambda extra: lambda s: F.struct(*(s[k] for k in (*PLACE, "value")), F.lit(extra).alias("extra"))
    every = F.concat(F.transform("base", tell(False)), F.transform("added", tell(True)))
    single = rows.where("size(base) + size(added) > 0").select("doc_id", "version", "owner", "repository", F.explode(every).alias("s")).withColumn("h", F.md5("s.value"))
    holders = single.groupBy("h", "owner", "repository").agg(F.count("*").alias("times"))
    by_owner = holders.groupBy("h", "owner").agg(F.count("*").alias("repositories"))
    owners = stage(by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "owners")
    live = owners.select("h", ((F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES)).alias("live"))
    judged = single.select("doc_id", "version", "s", "h").join(live, "h")
    span = F.struct(*(f"s.{k}" for k in PLACE), "s.extra", "live")
    mine = judged.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(span)).alias("judged"))
    mine = mine.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "judged")
    joined = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    own = F.coalesce("judged", F.array().cast(f"array<struct<{','.join(f'{k}:int' for k in PLACE)},extra:boolean,live:boolean>>"))
    return joined.select("doc_id", "version", F.filter(own, lambda s: ~s["extra"]).alias("base"), F.filter(own, lambda s: s["extra"] & s["live"]).alias("added"), F.filter(own, lambda s: s["live"]).alias("live"))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans that are sorted by start, then kind as listed, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in _KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live), one row per input row.

    A span is a whole match. Base spans stay whoever owns them; the method adds
    spans of values that only few own. No spans, as in an empty or null text:
    the empty string's digest. An empty table gives an empty result.
    """
    found = scan(docs, owner, repository)
    number = lambda kind: F.size(F.filter("base", lambda s: s["order"] == _KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k, *_ in BASE),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: Column | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with each live-looking secret in text replaced by `mark`; n_chars, if there, follows the new text.

    Every row and column stays, repeated rows and rows without a doc_id
    included; a null text stays null, and an empty table empty. Secrets that
    overlap become one mark. Copied examples stay as they are.
    """
    spans = scan(docs, owner, repository).where("size(live) > 0")
    spans = spans.select(F.col("doc_id").alias("_tw_id"), F.col("version").alias("_tw_version"), F.transform("live", lambda s: F.struct(s["byte_from"].alias("a"), s["byte_end"].alias("b"))).alias("_tw_live")).dropDuplicates(["_tw_id", "_tw_version"])
    spans = stage(spans, "live")  # documents with live secrets only
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_tw_id")) & (F.xxhash64("text") == F.col("_tw_version")), "left")

    def cut(raw: Column) -> Column:
        """Text between secrets, each by its bytes, so that the work is in proportion to the text."""
        between = lambda a, n: F.substring(raw, a + 1, n).cast("string")

        def pieces(known: Column) -> Column:
            ends = known["ends"]
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            parts = F.transform(known["spans"], lambda s, i: F.when(s["a"] >= before(i), F.concat(between(before(i), s["a"] - before(i)), F.lit(mark))).otherwise(F.lit("")))
            return F.array_join(F.concat(parts, F.array(between(before(F.size(ends)), F.lit(2**31 - 1)))), "")

        ordered = F.array_sort("_tw_live")
        return bind(F.struct(ordered.alias("spans"), running(F.transform(ordered, lambda s: s["b"]), F.greatest).alias("ends")), pieces)

    text = F.when(F.col("_tw_live").isNotNull(), bind(F.col("text").cast("binary"), cut)).otherwise(F.col("text"))
    done = joined.withColumn("_tw_text", text)
    size = lambda c: F.when(F.col("_tw_live").isNotNull(), F.char_length("_tw_text").cast(docs.schema[c].dataType)).otherwise(F.col(c))
    new = {"text": F.col("_tw_text").alias("text"), "n_chars": size("n_chars").alias("n_chars") if "n_chars" in docs.columns else None}
    return done.select(*(new.get(c) if c in new else F.col(c) for c in docs.columns))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_matches(at: int, kind: str, pattern: str, group: int, least: int) -> str:
    rx = _sql_text(pattern)
    return f"""select doc_id, owner, repository, {at} as ord, '{kind}' as kind, {at >= len(BASE)} as extra, {least} as least,
  string_split_regex(text, {rx}) as gaps, regexp_extract_all(text, {rx}, 0) as found, regexp_extract_all(text, {rx}, {group}) as vals from d"""


ORACLE_SQL = f"""
with d as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, concat_ws('/', source, lang) as repository from documents
), m as (
  {" union all ".join(_sql_matches(at, *k) for at, k in enumerate(BASE + ADDED))}
), one as (
  select * exclude (gaps, found, vals), length(gaps[i]) + coalesce(length(found[i - 1]), 0) as step, length(found[i]) as size, vals[i] as value
  from (select *, unnest(generate_series(1, len(found))) as i from m)
), placed as (
  select *, sum(step) over (partition by doc_id, ord order by i)::bigint as start from one
), good as (
  select *, start + size as stop from placed where length(value) >= least and (kind <> 'owned' or (
    {" and ".join(f"regexp_matches(value, {_sql_text(x)})" for x in OWNED_HAS)} and not regexp_matches(value, {_sql_text(OWNED_LACKS)})))
), s as (
  select * from good g where not extra or not exists (
    select 1 from good b where not b.extra and b.doc_id = g.doc_id and b.start < g.stop and g.start < b.stop)
), holders as (
  select value, count(distinct owner) <= {MAX_OWNERS} and count(distinct (owner, repository)) <= {MAX_REPOSITORIES} as live from s group by value
), told as (
  select s.*, live, kind || ':' || start || ':' || stop as span from s join holders using (value)
), digest as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    coalesce(string_agg(span, ',' order by start, ord) filter (not extra), '') as base,
    string_agg(span, ',' order by start, ord) filter (live or not extra) as spans, count(*) filter (live) as n_live
  from told group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from d left join digest using (doc_id)
"""
