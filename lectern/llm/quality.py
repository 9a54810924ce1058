"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule looks at one feature of a text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates each rule's accuracy and the share of good documents; the posterior
probability of a document's pattern then replaces an all-must-pass filter.

There are at most 3 ** len(RULES) patterns, however many documents there are: that bounds the array on which
the expectation-maximisation runs and the table of posteriors that is joined back.

Defined results: a null text has no words. Texts of no word fail the base rules. Repeated rows are judged each
for itself and alike. An empty table gives an empty result. Columns whose names clash with the added ones are
replaced by them; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

STOPWORDS = (
    "the of and to in is it that for with as on be at by this from are or an was le la les de des et en un une du que qui est "
    "pour dans par au sur der die das und zu den mit von ist nicht ein eine dem im el los del las se su con por para lo al"
).split()

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Repeated windows up to which a list of them is faster than a sort.
FEW = 24

#: name, feature, (bad where, good where); in between, or where the text is too short for the rule, it abstains.
RULES: list[tuple[str, str]] = [
    ("symbols", "CASE WHEN n_words = 0 THEN 0 WHEN n_symbols > 0.20 * n_words THEN -1 WHEN n_symbols <= 0.05 * n_words THEN 1 ELSE 0 END"),
    ("repeats", "CASE WHEN n_words < 20 THEN 0 WHEN n_repeat_words > 0.35 * n_words THEN -1 WHEN n_repeat_words <= 0.20 * n_words THEN 1 ELSE 0 END"),
    ("duplicate_lines", "CASE WHEN n_lines < 4 THEN 0 WHEN n_dup_lines > 0.40 * n_lines THEN -1 WHEN n_dup_lines <= 0.20 * n_lines THEN 1 ELSE 0 END"),
    ("word_length", "CASE WHEN n_words < 20 THEN 0 WHEN word_chars < 3.0 * n_words OR word_chars > 9.0 * n_words THEN -1 WHEN word_chars BETWEEN 4.0 * n_words AND 7.0 * n_words THEN 1 ELSE 0 END"),
    ("stopwords", "CASE WHEN n_words < 20 THEN 0 WHEN n_stopwords < 0.05 * n_words THEN -1 WHEN n_stopwords >= 0.12 * n_words THEN 1 ELSE 0 END"),
    ("letters", "CASE WHEN n_words < 20 THEN 0 WHEN n_letters < 0.75 * word_chars THEN -1 WHEN n_letters >= 0.90 * word_chars THEN 1 ELSE 0 END"),
    ("capitals", "CASE WHEN n_words < 20 THEN 0 WHEN n_capitals > 0.40 * n_letters THEN -1 WHEN n_capitals <= 0.15 * n_letters THEN 1 ELSE 0 END"),
]

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stopwords", "n_letters", "n_capitals"]


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text, in time near linear in the words.

    Windows are compared by 64-bit hashes. If few of them repeat, their places are looked up among these; if many
    do, (hash, place) pairs are sorted and places next to an equal hash are kept. Each place adds the words that
    the place before it did not cover.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)))

    def sorted_places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            n = F.size(p)
            same = lambda a, b: F.element_at(p, a)["h"] == F.element_at(p, b)["h"]
            hit = F.filter(p, lambda x, k: F.when(k > 0, same(k, k + 1)).otherwise(False) | F.when(k + 1 < n, same(k + 1, k + 2)).otherwise(False))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        return C.let(pairs, places)

    def covered(h: Column) -> Column:
        twice = C.let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.when(k > 0, F.element_at(s, k) == x).otherwise(False))))
        few = lambda d: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        at = C.let(twice, lambda d: F.when(F.size(d) <= FEW, few(d)).otherwise(sorted_places(h)))
        grown = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")))
        return grown["n"]

    some = C.let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(some).cast("long")


def _only(text: Column, outside: str) -> Column:
    """Characters left when those of the class outside are taken away."""
    return F.length(F.regexp_replace(text, outside, "")).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns FEATURES, over whole texts."""
    value = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for x in STOPWORDS for w in (x, x.capitalize())})

    def counts(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), _repeat_words(ws).alias("n_repeat_words"), F.size(F.filter(ws, lambda w: w.isin(stop))).cast("long").alias("n_stopwords"))

    def lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    kept = [c for c in docs.columns if c not in FEATURES]
    by_line = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(C.WHITE)) != "")
    out = docs.select(*kept, C.let(C.words(F.col(text)), counts).alias("_w"), C.let(by_line, lines).alias("_l"),
                      _only(value, C.WHITE_CLASS + "+").alias("word_chars"), _only(value, r"[^#*$%&|<>]+").alias("n_symbols"),
                      _only(value, r"\P{L}+").alias("n_letters"), _only(value, r"\P{Lu}+").alias("n_capitals"))
    return out.select(*kept, *[F.col(f"_w.{c}") if c in ("n_words", "n_repeat_words", "n_stopwords") else F.col(f"_l.{c}") if c in ("n_lines", "n_dup_lines") else F.col(c) for c in FEATURES])


def _pattern() -> Column:
    """All votes as one number in base three."""
    return sum(((F.expr(rule) + 1) * 3**i for i, (_, rule) in enumerate(RULES)), F.lit(0)).cast("int")


def fit(found: DataFrame, most_rounds: int = 2000, tolerance: float = 1e-9, good: float = 0.8, right_good: float = 0.98, right_bad: float = 0.5, weight: float = 20.0) -> DataFrame:
    """Posterior probability of good quality for each vote pattern: (pattern, posterior, model).

    found has the columns FEATURES, or pattern. Rounds end when no number of the model moved by more than tolerance; the query
    fails if most_rounds are not enough. A rule has two accuracies, as junk of one kind passes the rules for others:
    how often it votes good on good documents, and bad on bad ones, where it votes at all. good, right_good and
    right_bad are where expectation-maximisation starts and, with weight as so many imagined documents, what it
    leans to. Good votes stay right on at least 0.9 of the good and bad votes on at least 0.11 of the bad
    documents, so that a vote never turns into its opposite. A model is an array: the share of good documents,
    the rules' accuracies on good ones, then those on bad ones.
    """
    k = len(RULES)
    tally = found.select(F.col("pattern") if "pattern" in found.columns else _pattern().alias("pattern")).groupBy("pattern").agg(F.count("*").cast("double").alias("n"))
    votes = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.pmod(F.floor(F.col("pattern") / F.pow(F.lit(3.0), i)), F.lit(3)) - 1).cast("double"))
    table = tally.select("pattern", "n", votes.alias("v")).agg(F.sort_array(F.collect_list(F.struct("pattern", "n", "v"))).alias("ps"))

    one, zero = F.lit(1.0), F.lit(0.0)
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    total = lambda xs, f: F.aggregate(xs, zero, lambda s, x: s + f(x))

    def evidence(m: Column) -> Column:
        """For each rule what a good and what a bad vote add to the log-odds, after the log-odds of the share."""
        of = F.zip_with(F.slice(m, 2, k), F.slice(m, k + 2, k), lambda g, b: F.struct(F.log(g / (one - b)).alias("up"), F.log((one - g) / b).alias("down")))
        share = F.element_at(m, 1)
        return F.struct(F.log(share / (one - share)).alias("share"), of.alias("of"))

    def posterior(e: Column, v: Column) -> Column:
        odds = total(F.zip_with(v, e["of"], lambda x, r: F.when(x > 0, r["up"]).when(x < 0, r["down"]).otherwise(zero)), lambda x: x)
        return one / (one + F.exp(-(odds + e["share"])))

    def step(m: Column) -> Column:
        scored = C.let(evidence(m), lambda e: F.transform(F.col("ps"), lambda p: C.let(posterior(e, p["v"]), lambda q: F.struct((p["n"] * q).alias("g"), (p["n"] * (one - q)).alias("b"), p["v"].alias("v")))))

        def update(ps: Column) -> Column:
            share = clamp((total(ps, lambda p: p["g"]) + weight * good) / (total(ps, lambda p: p["g"] + p["b"]) + weight), 0.05, 0.99)

            def accuracy(i: Column, mass: str, sign: int, start: float, lo: float, hi: float) -> Column:
                hit = total(ps, lambda p: F.when(F.element_at(p["v"], i) == sign, p[mass]).otherwise(zero))
                cast = total(ps, lambda p: F.when(F.element_at(p["v"], i) != 0, p[mass]).otherwise(zero))
                return clamp((hit + weight * start) / (cast + weight), lo, hi)

            rules = F.sequence(F.lit(1), F.lit(k))
            return F.concat(F.array(share), F.transform(rules, lambda i: accuracy(i, "g", 1, right_good, 0.9, 0.9999)), F.transform(rules, lambda i: accuracy(i, "b", -1, right_bad, 0.11, 0.995)))

        return C.let(scored, update)

    start = F.array(F.lit(good), *[F.lit(right_good)] * k, *[F.lit(right_bad)] * k)
    state = lambda m, moved: F.struct(m.alias("m"), moved.alias("moved"))
    on = lambda s: C.let(step(s["m"]), lambda m: state(m, F.array_max(F.zip_with(m, s["m"], lambda x, y: F.abs(x - y)))))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(most_rounds)), state(start, one), lambda s, _: F.when(s["moved"] > tolerance, on(s)).otherwise(s))
    settled = lambda s: F.when(s["moved"] <= tolerance, s["m"]).otherwise(F.raise_error(F.lit(f"the rules' accuracies did not settle in {most_rounds} rounds")).cast("array<double>"))
    model = table.select("ps", C.let(fitted, settled).alias("m"))
    made = C.let(evidence(F.col("m")), lambda e: F.transform("ps", lambda p: F.struct(p["pattern"].alias("pattern"), posterior(e, p["v"]).alias("posterior"))))
    return model.select(F.explode(made).alias("p"), "m").select("p.pattern", "p.posterior", F.col("m").alias("model"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(found: DataFrame, model: DataFrame, threshold: float = 0.5) -> DataFrame:
    """found (with FEATURES) with base_failed, posterior and kept."""
    small = F.broadcast(model.select(F.col("pattern").alias("_pattern"), F.col("posterior")))  # at most 3 ** len(RULES) rows
    clean = found.drop("base_failed", "posterior", "kept")
    joined = clean.withColumn("_key", _pattern()).join(small, F.col("_key") == F.col("_pattern"), "left").drop("_key", "_pattern")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold))


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each document: id, features, base_failed, posterior, kept. Texts are read once."""
    found = C.materialise(features(docs.select(id_col, text), text).drop(text), "quality")
    return judge(found, C.materialise(fit(found), "quality-model"), threshold)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns. Features are computed once: rows that pass the base rules are written with their votes, for the second pass to choose from. Nothing is shuffled but counts of votes.

    The rules are learned on all rows, so of those that fail the base rules the votes are written, not the columns.
    """
    own = docs.columns
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    found = features(named, f"c{own.index(text)}").withColumn("failed", base_failed())
    row = F.when(~F.col("failed"), F.struct(*[f"c{i}" for i in range(len(own))]))
    voted = C.materialise(found.select(_pattern().alias("pattern"), row.alias("row")), "quality-votes")
    model = C.materialise(fit(voted.select("pattern")), "quality-model")
    good = F.broadcast(model.where(F.col("posterior") >= threshold).select(F.col("pattern").alias("_pattern")))  # at most 3 ** len(RULES) rows
    kept = voted.where("row IS NOT NULL").join(good, F.col("pattern") == F.col("_pattern"), "left_semi")
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(own)])
