"""Answers to keyword questions by an inverted index of character grams.

A question asks for the first text of its scope that holds all its words, each as a substring.
A text that holds a word holds every gram of it, so a question is looked up through a few grams
of its longest words alone and the words are tested on the texts it meets. Each scope keeps a
sieve of fixed size, a bit per hash of an asked gram: a text lists only grams that pass it, and
texts that list none go no further. Equal questions and equal texts of a scope count once, so a
scope full of copies is no table of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardmill.functions import answers
from guardmill.functions.rows import exploded
from guardmill.operators.joins import hot_keys, spread_join
from guardmill.operators.scratch import settled

GRAM = 4
#: Lengths of grams. A question takes the greatest that its longest word reaches.
SIZES = (GRAM, 6, 8, 12)
#: Grams that a question looks at, to go by the rarest of them.
PROBES = 4
#: Longs in the sieve of a scope. More questions make it coarser, never wrong.
SIEVE_LONGS = 32


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct grams of a text, none across white space."""
    # overlapping ones too: the pattern matches an empty string before each gram
    pattern = rf"(?=(\S{{{size}}}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def probes(words: Column) -> Column:
    """The grams a question is looked up by: of the greatest size that one of its words has,
    the PROBES least by hash."""
    def of_size(size):
        return F.array_distinct(F.flatten(F.transform(words, lambda word: grams(word, size))))

    chosen = F.get(F.filter(F.array(*map(of_size, reversed(SIZES))),
                            lambda found: F.size(found) > 0), 0)
    ranked = F.array_sort(F.transform(chosen, lambda gram: F.struct(
        F.xxhash64(gram).alias("h"), gram.alias("gram"))))
    return F.transform(F.slice(ranked, 1, PROBES), lambda one: one["gram"])


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(64 * SIEVE_LONGS)).cast("int")


def sieves(asked: DataFrame) -> DataFrame:
    """scope, sizes, sieve: the gram lengths asked in a scope and a bit per asked gram."""
    bits = asked.select("scope", F.length("gram").alias("size"), _bit(F.col("gram")).alias("b"))
    longs = [F.bit_or(F.when(F.shiftright("b", 6) == i, F.expr("shiftleft(1L, b & 63)"))
                      .otherwise(F.lit(0).cast("long"))) for i in range(SIEVE_LONGS)]
    return bits.groupBy("scope").agg(F.collect_set("size").alias("sizes"),
                                     F.array(*longs).alias("sieve"))


def sieved(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """`texts` (scope, lowered, more) that may hold an asked (scope, gram), with these as
    `listed`: all that they hold, and a few others that hash alike."""
    hot = hot_keys(texts.select("scope"), ["scope"])
    joined = spread_join(texts, settled(sieves(asked)), ["scope"], "inner", hot)
    none = F.array().cast("array<string>")
    held = F.concat(*(F.when(F.array_contains("sizes", size), grams(F.col("lowered"), size))
                      .otherwise(none) for size in SIZES))

    def passes(gram):
        return F.getbit(F.get("sieve", F.shiftright(_bit(gram), 6)),
                        _bit(gram).bitwiseAND(63)) == 1

    return joined.withColumn("listed", F.filter(held, passes)).filter(
        F.size("listed") > 0).select(*texts.columns, "listed")


def _asked_only(listed: DataFrame, asked: DataFrame) -> DataFrame:
    return exploded(listed, F.col("listed"), "gram", "scope", "text_key").join(
        asked.select("scope", "gram").distinct(), ["scope", "gram"], "left_semi")


def postings(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """scope, gram, text_key for the asked (scope, gram), with gram lengths of SIZES.

    A gram of a scope is a key with one row per text, however many ask for it."""
    return _asked_only(sieved(texts, asked), asked)


def first_texts(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """question, found, position, document_id: the first text of its scope that holds all
    words, one row per row of `questions`.

    questions: question, scope, words (lower case, distinct, one of GRAM characters or more);
    texts: scope, position, document_id, chunk_text. Questions without words, or whose words no
    text holds, are not found. Nulls in a scope match nothing; a null text holds nothing; of
    equal positions the least document id counts. Repeated questions are answered each for
    itself.
    """
    words = F.array_sort("words")
    asked = settled(questions.select("question", "scope", words.alias("words"),
                                     F.sha2(F.to_json(words), 256).alias("words_key")))
    # one question per scope and set of words; the words stay behind until texts are tested
    key = ["scope", "words_key"]
    single = asked.filter((F.size("words") > 0) & F.col("scope").isNotNull()).groupBy(
        *key).agg(F.any_value("words").alias("words"))
    question_grams = settled(exploded(single, probes(F.col("words")), "gram", *key))
    lowered = F.lower(F.coalesce("chunk_text", F.lit("")))
    held = texts.filter(F.col("scope").isNotNull()).select(
        "scope", "position", "document_id", lowered.alias("lowered"))
    single_texts = settled(sieved(held, question_grams).groupBy(
        "scope", F.sha2("lowered", 256).alias("text_key")).agg(
        F.min(F.struct("position", "document_id")).alias("first"),
        F.any_value("lowered").alias("lowered"), F.any_value("listed").alias("listed")))
    listed = settled(_asked_only(single_texts, question_grams))
    often = listed.groupBy("scope", "gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no text has makes its question unanswerable
    rarest = question_grams.join(often, ["scope", "gram"], "left").groupBy(*key).agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    through = rarest.filter("g.n > 0").select(*key, F.col("g.gram").alias("gram"))
    met = through.join(listed, ["scope", "gram"]).select(*key, "text_key")
    tested = met.join(single, key).join(
        single_texts.drop("listed"), ["scope", "text_key"]).filter(
        F.forall("words", lambda word: F.contains("lowered", word)))
    firsts = tested.groupBy(*key).agg(F.min("first").alias("f"))
    joined = spread_join(asked, firsts, key, "left", hot_keys(asked.select(*key), key))
    found = F.col("f").isNotNull()
    return joined.select(
        "question", found.alias("found"),
        F.when(found, F.col("f.position")).alias("position"),
        F.when(found, F.col("f.document_id")).alias("document_id"))


def first_values(intents: DataFrame, texts: DataFrame) -> DataFrame:
    """scope, intent, value: what the intent's patterns find in the first text of the scope
    where they find anything. One row per text and intent that matches is aggregated, so no
    question meets a text."""
    kinds = F.array(*(F.lit(name) for name in answers.intent_names()))
    per_text = exploded(texts.filter(F.col("scope").isNotNull()), kinds, "intent", "scope",
                        "position", "document_id",
                        F.coalesce("chunk_text", F.lit("")).alias("chunk_text"))
    wanted = intents.select("scope", "intent").distinct()
    valued = per_text.select(
        "scope", "position", "document_id", "intent",
        answers.answer_value(F.col("intent"), F.col("chunk_text")).alias("value")
    ).filter(F.col("value").isNotNull())
    return valued.groupBy("scope", "intent").agg(
        F.min(F.struct("position", "document_id", "value")).alias("f")).join(
        wanted, ["scope", "intent"]).select("scope", "intent", "f.value")
