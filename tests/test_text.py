from collections import Counter
import random
import re

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions import vectors as V


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).collect()[0].x


def test_token_count(spark):
    assert one(spark, X.token_count(F.col("t")), t="") == 0
    assert one(spark, X.token_count(F.col("t")), t=None) == 0
    assert one(spark, X.token_count(F.col("t")), t=" \n a") == 1
    assert one(spark, X.token_count(F.col("t")), t="one two three four five six seven eight nine") == 12


def test_truncate(spark):
    assert one(spark, X.token_count(X.truncate(F.col("t"), 20)), t="word " * 100) <= 25
    assert one(spark, X.truncate(F.col("t"), 20), t="short text") == "short text"
    assert one(spark, X.truncate(F.col("t"), -3), t="a b c") == "a ..."


def test_roles(spark):
    for raw, role in [("Human", "user"), (" BOT ", "assistant"), ("system", "system"), ("tool", "tool"), ("x", "user"), (None, "user")]:
        assert one(spark, X.normalize_role(F.col("t")), t=raw) == role


WORD = re.compile(r"(?<![^\W])[a-z]{3,}(?![\w])")


def summary_spec(text: str, limit: int) -> str:
    """The definition in plain Python, for ASCII texts."""
    count = lambda t: max(1, round(len(t.split()) / 0.75)) if t.strip() else 0
    cut = lambda t: t if count(t) <= limit else " ".join(t.split()[: max(1, round(limit * 0.75))]) + " ..."
    telling = lambda t: [w for w in WORD.findall(t.lower()) if w not in X.STOP_WORDS]
    found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    if not found:
        return cut(text)
    if len(found) == 1:
        return cut(found[0])
    top = {w for w, _ in Counter(telling(text)).most_common(20)}
    score = lambda s: round(len(set(telling(s)) & top) / len(set(telling(s))) + min(len(s.split()) / 20, 1) * 0.2, 9) if set(telling(s)) else 0.0
    ranked = sorted(found, key=lambda s: -score(s))
    chosen, used = [], 0
    for s in ranked:
        if used + count(s) > limit:
            break
        chosen.append(s)
        used += count(s)
    if not chosen:
        return cut(ranked[0])
    last = {s: i for i, s in enumerate(found)}
    return " ".join(sorted(chosen, key=last.__getitem__))


def test_extractive_against_definition(spark):
    random.seed(4)
    words = ["alpha", "beta", "gamma", "delta", "the", "is", "to", "epsilon", "zeta", "of", "x1"]
    texts = ["", "  ", "one.", "Same here. Same here. Same here. Other one is here."]
    texts += [" ".join(" ".join(random.choices(words, k=random.randint(1, 12))) + random.choice(".!?") for _ in range(random.randint(1, 9))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.extractive(F.col("t"), 25).alias("s")).collect()
    for r in rows:
        assert r.s == summary_spec(texts[r.i], 25), texts[r.i]


def test_vectors(spark):
    row = spark.range(1).select(V.norm(V.hashed_embedding(F.lit("alpha beta alpha"), 64)).alias("n"), V.norm(V.hashed_embedding(F.lit("a b"), 64)).alias("z")).collect()[0]
    assert abs(row.n - 1) < 1e-9 and row.z == 0


def test_python_forms_give_what_the_columns_give(spark):
    """Odd white space, line terminators, ties, long words, other scripts, null and empty texts."""

    from pyspark.sql import types as T

    from palimpsest.functions import python_text as P

    rng = random.Random(3)
    parts = ["alpha", "beta", "Gamma", "delta3", "x_y", "the", "of", "naïve", "ΣΑΣ", "İstanbul", "straße", "K9", "中文", "omega", "́e"]
    gaps = [" ", ". ", "! ", "?\n", ".\u0085", " \u0085", ". ", "\x1f", "\t", "\r\n", ".\x0b", ", ", "...  ", "\xa0", ".  "]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.choice([1, 2, 5, 20, 200]))) for _ in range(300)]
    texts += [None, "", " ", ".", " \u0085", "a.  b. \u0085", "\u0085", " lead. tail  ", "abc. abc. abc.", "One. " * 60, " ".join(f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100]}" for k in range(1000)) + ". End here."]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    t = F.col("t")

    def table(most, budget):
        ranked = X.scored_sentences(X.sentences(t), X.top_words(X.telling_words(t), most))
        rows = frame.where(F.size(X.sentences(t)) >= 2).select("i", X.fitting(ranked, budget).alias("n"), F.posexplode(ranked).alias("rank", "x"))
        return sorted((r.i, r.pos, r.score, r.picked) for r in rows.select("i", "x.pos", (0 - F.col("x.minus_score")).alias("score"), (F.col("rank") < F.col("n")).alias("picked")).collect())

    for most, budget in ((20, 25), (2, 5)):
        found = frame.select("i", F.explode(P.sentence_table(t, most, budget)).alias("x")).select("i", "x.*").collect()
        assert sorted((r.i, r.pos, r.score, r.picked) for r in found) == table(most, budget)
    both = frame.select(
        "i", X.extractive(t, 25).alias("a"), P.extractive(t, 25).alias("b"), F.when(X.token_count(t) <= 25, t).otherwise(X.extractive(t, 25)).alias("c"), P.extractive(t, 25, whole=True).alias("d"),
        P.each_extractive(F.array("t", "t"), F.array(F.lit(25), F.lit(26)), 25).alias("e"), V.hashed_embedding(t, 16).alias("f"), P.hashed_embedding(t, 16).alias("g"),
    )
    for r in both.collect():
        assert (r.a, r.c, r.f) == (r.b, r.d, r.g) and r.e == [texts[r.i], r.b]
    assert both.schema["g"].dataType == T.ArrayType(T.DoubleType())


def test_scores_are_not_interpreted_by_lambdas(spark, sf):
    """Sentences' scores come from one Python stage over the texts, which reads each text once."""
    from palimpsest.plans import queries

    for name in ("sentence_scores", "summarizer_trace"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1 and "transform(" not in plan
