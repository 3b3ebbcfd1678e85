r"""Secret scan: base patterns and character Markov models, in DataFrame functions only.

Base kinds (leftmost, not overlapping within a kind) are key assignments, access keys and long
hexadecimal strings.  The method adds tokens of ``MIN_TOKEN`` or more characters whose character
pairs are likelier in random strings than in ordinary identifiers.  Both first-order models are
trained from labelled samples.  Random are the hexadecimal and access values that the base patterns found in all documents and
``seeded`` digests of the numbers 0, 1, ... in base64, hexadecimal, alphanumeric and UUID form; ordinary are the
words of the ``sample_docs`` different texts with the smallest hash of those without a base match, and identifiers composed of
them (camel, snake, kebab and upper case): bounded samples.  Half of the strings, by hash, train; the threshold lies between the
ratios of the other half, midway between the 99.5 % quantile of the ordinary and the 0.5 % quantile of the random ones.
Only the pair counts, at most twice 67 x 67, and two quantiles reach the driver.

Positions are code points; the end is exclusive.  A null text counts as empty.  Whole texts are
scanned, but only documents with some match are shuffled.  Rows are told apart by id and a hash
of the text: repeated rows give the same result again.  Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import quoted

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is maximal from its leftmost start, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("markov", TOKEN))
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(quoted(text), F.lit(""))
    return docs.select(quoted(key).alias("id"), F.xxhash64(body).alias("version"), body.alias("body"))


def base_and_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, version, kind, name, start, end, found)`` of all base matches and of all tokens."""
    some = _texts(docs, key, text).filter(F.col("body").rlike("|".join(
        (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", ACCESS, HEX, TOKEN)))).dropDuplicates(["id", "version"])
    per_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(name).alias("name"),
                                  F.split("body", regex, -1).alias("between"), F.regexp_extract_all("body", F.lit(regex), F.lit(0)).alias("found"))
                         for k, (name, regex) in enumerate(KINDS)])
    rows = some.select("id", "version", F.explode(per_kind).alias("m")).filter(F.size("m.found") > 0)
    pairs = F.arrays_zip(F.transform("m.between", lambda x: F.length(x)).alias("gap"), F.col("m.found").alias("found"))
    rows = rows.select("id", "version", "m.kind", "m.name", F.posexplode(pairs).alias("i", "p")).filter("p.found is not null")
    rows = rows.select("id", "version", "kind", "name", "i", F.col("p")["gap"].alias("gap"), F.col("p")["found"].alias("found"))
    before = Window.partitionBy("id", "version", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("found")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("found"))
    return rows.filter((F.col("name") != "assign") | (F.length(F.regexp_extract("found", ASSIGN, 2)) >= 8)).select(
        "id", "version", "kind", "name", "start", "end", "found")


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of adjacent characters of column ``s``."""
    chars = strings.select(F.split("s", "").alias("c"))
    chars = chars.select(F.filter("c", lambda x: x != "").alias("c")).filter(F.size("c") > 1)
    both = chars.select(F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    return both.select("p.a", "p.b").groupBy("a", "b").count()


def random_strings(docs: DataFrame, matches: DataFrame, seeded: int) -> DataFrame:
    """Column ``s``: the labelled random strings."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    forms = [F.regexp_replace(b64, "=", ""), F.translate(F.substring(b64, 1, 32), "+/", "-_"), F.regexp_replace(b64, "[^A-Za-z0-9]", ""), F.substring(digest, 1, 40),
             F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")]
    made = docs.sparkSession.range(seeded).select(F.explode(F.array(*forms)).alias("s"))
    return made.union(matches.filter("name in ('hex', 'access')").select("found")).distinct()


def ordinary_texts(docs: DataFrame, matches: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 2000) -> DataFrame:
    """Column ``body``: the different texts with the smallest hash of those without a base match."""
    found = matches.filter("name <> 'markov'").select("version").distinct()
    texts = _texts(docs, key, text).select("version", "body")
    smallest = texts.select("version").distinct().join(found, "version", "left_anti").orderBy("version").limit(sample_docs)
    return texts.join(F.broadcast(smallest), "version").dropDuplicates(["version"]).select("body")   # at most sample_docs rows


def ordinary_strings(bodies: DataFrame) -> DataFrame:
    """Column ``s``: the words of the texts, and identifiers composed of every 16th run of four."""
    words = F.regexp_extract_all("body", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])"), F.lit(0))   # not pieces of tokens
    bodies = bodies.select(words.alias("w"))
    runs = bodies.filter(F.size("w") > 3).select(F.explode(F.sequence(F.lit(1), F.size("w") - 3, F.lit(16))).alias("i"), "w").select(F.slice("w", F.col("i"), F.lit(4)).alias("r"))
    title = F.transform("r", lambda x: F.initcap(x))
    lower = F.transform("r", lambda x: F.lower(x))
    camel = F.concat(F.lower(F.get("r", F.lit(0))), F.array_join(F.slice(title, 2, 3), ""))
    forms = [camel, F.array_join(title, ""), F.array_join(lower, "_"), F.array_join(lower, "-"), F.upper(F.array_join(lower, "_"))]
    plain = bodies.select(F.explode("w").alias("s"))
    return plain.union(runs.select(F.explode(F.array(*forms)).alias("s")))


def train(random: DataFrame, ordinary: DataFrame) -> tuple[list[int], float]:
    """Log-likelihood ratio (random to ordinary, in thousandths) of each pair of ``ALPHABET``, and the threshold."""
    n = len(ALPHABET)
    kept = lambda strings, side: strings.filter(F.pmod(F.xxhash64("s"), F.lit(2)) == side)

    def logs(rows, weight: float, backed: float) -> list[list[float]]:
        """Logarithms of P(b | a); a share ``backed`` of it knows the kinds of the two characters only, for pairs of words not seen."""
        counts, kinds = [[0.0] * n for _ in range(n)], [[1.0] * 4 for _ in range(4)]
        for r in rows:
            if r["a"] in ALPHABET and r["b"] in ALPHABET:
                i, j = ALPHABET.index(r["a"]), ALPHABET.index(r["b"])
                counts[i][j] += r["count"]
                kinds[kind[i]][kind[j]] += r["count"]
        of_pair = [[(x + weight) / (sum(row) + weight * n) for x in row] for row in counts]
        of_kind = [[kinds[kind[i]][kind[j]] / sum(kinds[kind[i]]) / kind.count(kind[j]) for j in range(n)] for i in range(n)]
        return [[math.log((1 - backed) * of_pair[i][j] + backed * of_kind[i][j]) for j in range(n)] for i in range(n)]

    # the prior of random strings is uniform and firm, that of identifiers thin
    kind = [0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in ALPHABET]
    p, q = logs(_pairs(kept(random, 0)).collect(), 1.0, 0.0), logs(_pairs(kept(ordinary, 0)).collect(), 0.2, 0.1)
    table = [round(1000 * (p[i][j] - q[i][j])) for i in range(n) for j in range(n)]

    def quantile(strings: DataFrame, share: float) -> float | None:
        held = kept(strings, 1).filter(F.col("s").rlike(f"^{TOKEN}$")).distinct()
        return held.select(_ratio(F.col("s"), table).alias("r")).agg(F.percentile_approx("r", share, 10000)).first()[0]

    low, high = quantile(ordinary, 0.995), quantile(random, 0.005)
    low = high - 1.0 if low is None else low     # no long ordinary token: no evidence against the random ones
    return table, (low + high) / 2


def _ratio(token: Column, table: list[int]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    weights = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<int>")  # folded to a constant
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    zipped = F.arrays_zip(F.slice(places, F.lit(1), F.length(token) - 1).alias("a"), F.slice(places, F.lit(2), F.length(token) - 1).alias("b"))
    total = F.aggregate(zipped, F.lit(0).cast("long"), lambda acc, x: acc + F.get(weights, x["a"] * len(ALPHABET) + x["b"]))
    return total / (F.length(token) - 1) / 1000


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float | None = None, sample_docs: int = 2000, seeded: int = 2000) -> DataFrame:
    """``key`` and ``spans``, an array of ``(start, kind, name, end, found, ratio)`` by start and kind, of every row.

    Added tokens overlap no base match."""
    matches = base_and_tokens(docs, key, text).checkpoint()
    table, learned = train(random_strings(docs, matches, seeded), ordinary_strings(ordinary_texts(docs, matches, key, text, sample_docs)).checkpoint())
    threshold = learned if threshold is None else threshold
    # running frames from either end: a frame to the end of the text for each token would be quadratic
    base_end = F.max(F.when(F.col("name") != "markov", F.col("end"))).over(
        Window.partitionBy("id", "version").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1))
    base_next = F.min(F.when(F.col("name") != "markov", F.col("start"))).over(
        Window.partitionBy("id", "version").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce(base_end, F.lit(-1)) <= F.col("start")) & F.coalesce(base_next >= F.col("end"), F.lit(True))
    scored = matches.withColumn("free", free).withColumn(
        "ratio", F.when(F.col("name") == "markov", _ratio(F.col("found"), table)))
    scored = scored.filter((F.col("name") != "markov") | (F.col("free") & (F.col("ratio") > threshold)))
    spans = scored.groupBy("id", "version").agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "name", "end", "found", "ratio"))).alias("spans"))
    spans = spans.withColumnsRenamed({"id": "_id", "version": "_v"})
    rows = _texts(docs, key, text).select("id", "version")
    return (rows.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v")), "left")
            .select(F.col("id").alias(key), "spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    def n(name: str) -> Column:
        count = F.size(F.filter("spans", lambda s: s["name"] == name))
        return F.when(F.col("spans").isNull(), 0).otherwise(count).cast("long").alias(f"n_{name}")

    def joined(x: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))

    base, spans = F.filter("spans", lambda s: s["name"] != "markov"), F.col("spans")
    return found.select(key, n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
