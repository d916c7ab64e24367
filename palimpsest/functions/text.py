"""Text as Column expressions: token counts, truncation, sentences, words, ranks and extractive summaries.

All of it is narrow: a summary of a text of any length is one expression in the scan's stage, without explode, shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of labels and summaries, and those that queries lose besides.
STOP_WORDS = [
    "i", "me", "my", "the", "a", "an", "is", "it", "to", "do", "of", "and", "or", "in", "on", "at", "for", "with", "that", "this",
    "was", "are", "be", "have", "has", "had", "you", "your", "we", "can", "will", "would", "could", "should", "what", "how", "why",
    "when", "where", "about", "just", "so", "but", "if", "not", "no",
]
QUERY_STOP_WORDS = [*STOP_WORDS, "tell", "explain", "describe", "give", "show", "help"]
# The roles' aliases.
ROLES = {"user": ["user", "human"], "assistant": ["assistant", "ai", "bot", "model"], "system": ["system"], "tool": ["tool"]}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. Without it, an expression that a lambda names is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def words(text: Column) -> Column:
    """The text's pieces between white space; a blank text has one empty piece."""
    return F.split(strip(text), "\\s+")


def token_count(text: Column) -> Column:
    """Estimated tokens: words / 0.75, rounded, 1 at least; 0 for a blank or null text."""
    count = lambda s: F.greatest(F.lit(1), F.round(F.size(F.split(s, "\\s+")) / F.lit(0.75)).cast("int"))
    return let(F.coalesce(strip(text), F.lit("")), lambda s: F.when(s == "", F.lit(0)).otherwise(count(s)).cast("int"))


def truncate(text: Column, tokens: Column | int) -> Column:
    """The text where it has no more than `tokens` tokens, else its first words and an ellipsis."""
    limit = F.lit(tokens) if isinstance(tokens, int) else tokens

    def cut(x: Column) -> Column:
        keep = F.greatest(F.lit(1), F.bround(x["limit"] * F.lit(0.75)).cast("int"))
        return F.when(token_count(x["text"]) <= x["limit"], x["text"]).otherwise(F.concat(F.array_join(F.slice(words(x["text"]), F.lit(1), keep), " "), F.lit(" ...")))

    return let(F.struct(text.alias("text"), limit.cast("int").alias("limit")), cut)


def normalize_role(role: Column) -> Column:
    """One of user, assistant, system, tool; anything else, null included, is user."""
    plain = F.lower(strip(role))
    out = F.when(plain.isin(ROLES["assistant"]), "assistant")
    return out.when(plain.isin(ROLES["system"]), "system").when(plain.isin(ROLES["tool"]), "tool").otherwise("user")


def content_words(text: Column) -> Column:
    """Lower-cased words of three ASCII letters or more, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), 1), lambda w: w.rlike("^[a-z]{3,}$"))


def stop_array(stop: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in stop])


def telling_words(text: Column) -> Column:
    """content_words without stop words."""
    return F.filter(content_words(text), lambda w: ~w.isin(STOP_WORDS))


def sentences(text: Column) -> Column:
    """Stripped, non-blank sentences, in order."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+"), strip), lambda s: s != "")


def ranked_words(word_array: Column, most: int) -> Column:
    """array<struct<minus_n, first, word>> of the most frequent words; ties by first occurrence.

    Words are sorted with their places, equal ones stand together, and each run's head gives a word's count and first place.
    """
    placed = F.sort_array(F.transform(word_array, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def runs(p: Column) -> Column:
        new = lambda x, i: (i == 0) | (F.get(p, i - 1)["w"] != x["w"])
        heads = F.filter(F.transform(p, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())
        counted = lambda h: F.transform(h, lambda at, k: F.struct((at - F.coalesce(F.get(h, k + 1), F.size(p))).alias("minus_n"), F.get(p, at)["i"].alias("first"), F.get(p, at)["w"].alias("word")))
        return F.slice(F.sort_array(let(heads, counted)), 1, most)

    return let(placed, runs)


def top_words(word_array: Column, most: int) -> Column:
    return F.transform(ranked_words(word_array, most), lambda x: x["word"])


def sentence_score(sentence: Column, top: Column) -> Column:
    """Share of the sentence's telling words that are top words, and up to 0.2 for length; 0 without telling words. Rounded to nine places."""

    def score(own: Column) -> Column:
        share = F.size(F.array_intersect(own, top)) / F.size(own) + F.least(F.size(words(sentence)) / F.lit(20.0), F.lit(1.0)) * F.lit(0.2)
        return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.round(share, 9))

    return let(F.array_distinct(telling_words(sentence)), score)


def scored_sentences(sentence_array: Column, top: Column) -> Column:
    """array<struct<minus_score, pos, sentence, tok>> in rank order: best score first, ties by place."""
    row = lambda t: lambda s, i: F.struct((0 - sentence_score(s, t)).alias("minus_score"), i.alias("pos"), s.alias("sentence"), token_count(s).alias("tok"))
    return let(top, lambda t: F.sort_array(F.transform(sentence_array, row(t))))


def fitting(ranked: Column, tokens: int) -> Column:
    """How many ranked sentences stand before the first that overflows the budget."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        over = s["over"] | (s["used"] + x["tok"] > tokens)
        return F.struct(F.when(over, s["used"]).otherwise(s["used"] + x["tok"]).alias("used"), F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"), over.alias("over"))

    return F.aggregate(ranked, start, step, lambda s: s["n"])


def extractive(text: Column, tokens: int) -> Column:
    """The best-ranked sentences that fit `tokens`, in text order (equal sentences at the last one's place); else the cut text or best sentence."""

    def summary(x: Column) -> Column:
        found, ranked = x["found"], x["ranked"]
        last = lambda back: lambda s, i: F.struct((F.size(back) - F.array_position(back, s["sentence"])).alias("at"), i.alias("rank"), s["sentence"].alias("sentence"))
        joined = lambda chosen: let(F.reverse(found), lambda back: F.array_join(F.transform(F.sort_array(F.transform(chosen, last(back))), lambda y: y["sentence"]), " "))
        many = let(fitting(ranked, tokens), lambda n: F.when(n > 0, joined(F.slice(ranked, F.lit(1), n))).otherwise(truncate(F.get(ranked, F.lit(0))["sentence"], tokens)))
        return F.when(F.size(found) == 0, truncate(x["text"], tokens)).when(F.size(found) == 1, truncate(F.get(found, F.lit(0)), tokens)).otherwise(many)

    def ranked(x: Column) -> Column:
        return F.struct(x["text"].alias("text"), x["found"].alias("found"), scored_sentences(x["found"], top_words(telling_words(x["text"]), 20)).alias("ranked"))

    base = let(text, lambda t: F.struct(t.alias("text"), sentences(t).alias("found")))
    return let(let(base, ranked), summary)
