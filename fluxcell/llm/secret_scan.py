"""Secret scan: pattern spans plus high-entropy strings, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxcell.llm.common import table

# The base patterns and the least lengths their matches must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of 20 or more; the pattern takes whole runs, so shorter ones never match
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "struct<start:int,end:int,kind:int,hit:string>"
KINDS = ("assign", "access", "hex", "entropy")

# Entropy, in bits a character, that some window of the string must reach, by character class.
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "base64": 3.8}

# Allow-list: strings that look random to an entropy measure but are not secrets. Each entry is a
# pattern that must be found and one that must not; all of them take linear time and no stack.
ALLOW = (
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None),  # UUIDs
    # slugs and paths: parts of letters alone or digits alone
    (r"[/_-]", r"[A-Za-z][0-9]|[0-9][A-Za-z]|[/_-]{2}|[+=]|^[/_-]|[/_-]$"),
    (r"(?i)example|sample|placeholder|dummy", None),
)

SCAN = 256  # items that a scan gathers before it starts another list
CHUNK = 4096  # characters of a candidate that are taken apart together


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], item: str) -> Column:
    """The items that ``step(carry, value) -> (carry, item)`` gives for an array's values in turn.

    Appending to an array copies it, so items are gathered by ``SCAN`` and the lists then joined:
    the cost stays near linear for long arrays.
    """

    def advance(s: Column, x: Column) -> Column:
        carry, out = step(s["carry"], x)
        return F.struct(carry.alias("carry"), F.concat(s["out"], F.array(out.cast(item))).alias("out"))

    def advance_all(s: Column, some: Column) -> Column:
        begin = F.struct(s["carry"].alias("carry"), F.array().cast(f"array<{item}>").alias("out"))
        part = F.aggregate(some, begin, advance)
        return let(
            part, lambda p: F.struct(p["carry"].alias("carry"), F.concat(s["out"], F.array(p["out"])).alias("out"))
        )

    def run(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SCAN).cast("int"))
        parts = F.transform(starts, lambda k: F.slice(v, k * SCAN + 1, F.lit(SCAN)))
        begin = F.struct(zero.alias("carry"), F.array().cast(f"array<array<{item}>>").alias("out"))
        return F.flatten(F.aggregate(parts, begin, advance_all, lambda s: s["out"]))

    empty = F.array().cast(f"array<{item}>")
    return let(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(empty))


def found(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, end, kind, hit>> of a pattern's leftmost non-overlapping matches, in code points.

    The text between matches (split) and the matches alternate, so their lengths give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = let(
        hits,
        lambda h: F.zip_with(
            h, F.slice(gaps, F.lit(1), F.size(h)), lambda x, g: F.struct(F.length(g).alias("gap"), x.alias("hit"))
        ),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), scan(pairs, F.lit(0), step, SPAN)).otherwise(none)


def window_bits(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any ``window`` characters in a row of a string over ``ALPHABET``.

    The counts of the window's characters change at two places a step, by the one that enters and
    the one that leaves, and with them the sum of c*log2(c) from which the entropy follows. The
    counts are packed, some to a 64-bit word. Long strings are taken in overlapping chunks, so
    that each window lies in one of them and memory is that of a chunk. 0 for shorter strings.
    """
    width = window.bit_length()
    per = 62 // width
    words = -(-(len(ALPHABET) + 1) // per)
    mask = (1 << width) - 1
    weight = F.array(*[F.lit(float(c) * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def place(code: Column) -> Column:
        return F.struct(F.floor(code / per).cast("int").alias("word"), (code % per * width).cast("int").alias("shift"))

    def bits(chunk: Column) -> Column:
        codes = F.transform(F.split(chunk, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        pairs = let(
            F.transform(codes, place),
            lambda p: F.zip_with(
                p,
                F.concat(F.array_repeat(F.lit(None).cast("struct<word:int,shift:int>"), window), p),
                lambda x, y: F.struct(x.alias("into"), y.alias("out")),
            ),
        )
        pairs = F.filter(pairs, lambda x: x["into"].isNotNull())
        begin = F.struct(
            F.array_repeat(F.lit(0).cast("long"), words).alias("n"),
            F.lit(0.0).alias("sum"),
            F.lit(0).alias("seen"),
            F.lit(float("inf")).alias("least"),
        )

        def change(n: Column, total: Column, x: Column, by: int, then: Callable[[Column, Column], Column]) -> Column:
            """The counts and the sum when character ``x`` comes in (by = 1) or goes out (by = -1)."""
            at = lambda k: F.call_function("shiftleft", F.lit(by).cast("long"), k)
            count = F.call_function("shiftright", F.get(n, x["word"]), x["shift"]).bitwiseAND(F.lit(mask)).cast("int")
            return let(
                count,
                lambda c: then(
                    F.transform(n, lambda v, i: F.when(i == x["word"], v + at(x["shift"])).otherwise(v)),
                    total + F.get(weight, c + by) - F.get(weight, c),
                ),
            )

        def into(seen: Column, least: Column, x: Column) -> Callable[[Column, Column], Column]:
            return lambda n, total: F.struct(
                n.alias("n"),
                total.alias("sum"),
                (seen + 1).alias("seen"),
                F.when(seen + 1 >= window, F.least(least, total)).otherwise(least).alias("least"),
            )

        def step(a: Column, x: Column) -> Column:
            after = lambda n, total: change(n, total, x["into"], 1, into(a["seen"], a["least"], x))
            out = lambda n, total: let(F.struct(n.alias("n"), total.alias("sum")), lambda s: after(s["n"], s["sum"]))
            return F.when(x["out"].isNull(), after(a["n"], a["sum"])).otherwise(
                change(a["n"], a["sum"], x["out"], -1, out)
            )

        return F.aggregate(pairs, begin, step, lambda a: a["least"])

    def run(b: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.length(b) - window) / CHUNK), F.lit(0)).cast("int"))
        part = lambda k: F.substring(b, k * CHUNK + 1, F.lit(CHUNK + window - 1)).cast("string")
        least = F.array_min(F.transform(chunks, lambda k: bits(part(k))))
        return F.greatest(F.lit(math.log2(window)) - least / window, F.lit(0.0))

    return let(s.cast("binary"), run)


def joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")


def secret_spans(
    docs: DataFrame, window: int = WINDOW, allow: tuple[tuple[str, str | None], ...] = ALLOW
) -> DataFrame:
    """``docs`` plus ``base_spans`` and ``spans``: array<struct<start, end, kind, hit>>, places in code points.

    Base spans are the matches of the three patterns. Further candidate strings are those of
    base64 letters, 20 or more, that hold a digit and a letter; the entropy of each window of
    ``window`` characters is followed through the string, and one whose best window reaches its
    class's least bits is a span of kind ``entropy`` unless the allow-list knows it or a base
    span covers it. An allow-list entry is a pattern to be found in the string and one that may
    not be.

    Null text counts as empty: no spans. Texts of any length are scanned whole, in time near
    linear in their length and the number of their matches. Spans are sorted by start, then kind.
    Repeated rows each get their own spans. An empty table gives an empty one. Columns named like
    the new ones are replaced; others pass through.
    """
    docs = docs.drop("base_spans", "spans")
    text = F.coalesce("text", F.lit(""))
    key = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"))  # noqa: E731, E501
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["hit"].alias("hit"))  # noqa: E731, E501
    value = lambda x: F.regexp_extract(x["hit"], ASSIGN, 2)
    assign = F.filter(found(text, ASSIGN, 0), lambda x: F.length(value(x)) >= ASSIGN_VALUE)
    base = F.concat(assign, found(text, ACCESS, 1), found(text, HEX, 2))
    candidates = F.filter(
        found(text, CANDIDATE, 3), lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")
    )

    def uncovered(reach: Column, x: Column) -> tuple[Column, Column]:
        """How far base spans reach so far; the span, and whether it is a base span or one that none covers."""
        is_base = x["kind"] < 3
        new = F.struct(span(x).alias("span"), (is_base | (reach < x["end"])).alias("open"))
        return F.when(is_base, F.greatest(reach, x["end"])).otherwise(reach), new

    def high(x: Column) -> Column:
        known = F.lit(False)
        for has, lacks in allow:
            known = known | (x["hit"].rlike(has) & (F.lit(True) if lacks is None else ~x["hit"].rlike(lacks)))
        least = F.when(x["hit"].rlike("[^0-9a-fA-F]"), F.lit(LEAST_BITS["base64"])).otherwise(F.lit(LEAST_BITS["hex"]))
        return F.when(known, F.lit(False)).otherwise(window_bits(x["hit"], window) >= least)

    def with_entropy(spans: Column) -> Column:
        told = scan(spans, F.lit(0), uncovered, f"struct<span:{SPAN},open:boolean>")
        kept = F.filter(told, lambda x: x["open"] & F.when(x["span"]["kind"] < 3, F.lit(True)).otherwise(high(x["span"])))
        return F.transform(kept, lambda x: x["span"])

    out = docs.withColumns({"__base": F.array_sort(F.transform(base, key)), "__more": F.transform(candidates, key)})
    spans = F.when(F.size("__more") > 0, with_entropy(F.array_sort(F.concat("__base", "__more"))))
    return out.withColumn("base_spans", F.transform("__base", span)).withColumn(
        "spans", F.coalesce(spans, "base_spans")
    ).drop("__base", "__more")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


# The entropy of every window, afresh, over candidates that no base span covers and the allow-list doesn't know.
OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), patterns AS (
  SELECT unnest(['assign', 'access', 'hex', 'entropy']) AS kind, unnest([0, 1, 2, 3]) AS k
), hits AS (
  SELECT doc_id, 0 AS k, regexp_extract_all(text, '{assign}') AS hit, string_split_regex(text, '{assign}') AS gap FROM docs
  UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '{access}'), string_split_regex(text, '{access}') FROM docs
  UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '{hex}'), string_split_regex(text, '{hex}') FROM docs
  UNION ALL SELECT doc_id, 3, regexp_extract_all(text, '{candidate}'), string_split_regex(text, '{candidate}') FROM docs
), places AS (
  SELECT doc_id, k, hit, unnest(range(1, len(hit) + 1)) AS i,
         list_transform(hit, lambda x: length(x)) AS wide, list_transform(gap, lambda x: length(x)) AS apart
  FROM hits
), spans AS (
  SELECT doc_id, k, hit[i] AS hit,
         (list_sum(apart[1:i]) + coalesce(list_sum(wide[1:i - 1]), 0))::BIGINT AS start,
         (list_sum(apart[1:i]) + list_sum(wide[1:i]))::BIGINT AS stop
  FROM places
), base AS (
  SELECT * FROM spans WHERE k IN (1, 2) OR k = 0 AND length(regexp_extract(hit, '{assign}', 2)) >= 6
), candidates AS (
  SELECT * FROM spans s WHERE k = 3 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start <= s.start AND s.stop <= b.stop)
  AND NOT regexp_matches(hit, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
  AND NOT (regexp_matches(hit, '[/_-]') AND NOT regexp_matches(hit, '[A-Za-z][0-9]|[0-9][A-Za-z]|[/_-][/_-]|[+=]|^[/_-]|[/_-]$'))
  AND NOT regexp_matches(lower(hit), 'example|sample|placeholder|dummy')
), windows AS (
  SELECT hit, unnest(range(1, length(hit) - 18)) AS place FROM (SELECT DISTINCT hit FROM candidates)
), letters AS (
  SELECT hit, place, unnest(string_split(substr(hit, place, 20), '')) AS letter FROM windows
), bits AS (
  SELECT hit, max(e) AS bits FROM (SELECT hit, place, entropy(letter) AS e FROM letters GROUP BY hit, place) GROUP BY hit
), entropic AS (
  SELECT doc_id, k, hit, start, stop FROM candidates JOIN bits USING (hit)
  WHERE bits >= CASE WHEN regexp_matches(hit, '[^0-9a-fA-F]') THEN 3.8 ELSE 3.0 END
), named AS (
  SELECT doc_id, k, start, kind || ':' || start || ':' || stop AS span
  FROM (SELECT * FROM base UNION ALL SELECT * FROM entropic) JOIN patterns USING (k)
), told AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
         count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base,
         string_agg(span, ',' ORDER BY start, k) AS spans
  FROM named GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (doc_id)
""".format(
    assign=ASSIGN.replace("'", "''"), access=ACCESS, hex=HEX, candidate=CANDIDATE
)
