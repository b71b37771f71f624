"""Negation/antonym rule: lexicon table, per-hit flags and the rule decision.

Semantics (see README, "rule decision"): the antonym dictionary is built in
both directions from the CSV rows, keys in first-insertion order and each
key's antonyms in row order. Walking it, every (word, antonym) with word in
the reference tokens and antonym in the MT tokens is a *hit*; each hit may
write a value and the last writing hit wins:

    v = 1     if some antonym a of word is in both MT and reference
    v = 0     elif the negation counts are equal
    v = 1     elif exactly one side has a negation within 2 tokens of the
              first occurrence of word or antonym
    (no write) otherwise

The start value is 0 when the negation counts differ, else null.

With a lemma table, a word or antonym is also met by its lemma: a hit needs a form of the word among the
reference tokens and a form of the antonym among the MT tokens. Adjacency and the cross check look at surface
forms alone, and the cross check then also needs one of the antonym's own antonyms in the reference (without lemmas
the word itself is one). The lexicon is keyed on forms: each word's entries stand under the word and under its lemma.

Two physical plans find, per pair, each side's few lexicon tokens with their entries and
the negation flag of their first occurrence; one expression turns these into hits:

* ``rule_decision`` embeds a lexicon of checked size as one constant (``lexmap``) and
  looks every token up inside the row: no shuffle, no join, one pass.
  ``antonym_hits`` explodes the hits of this plan.
* For larger lexicons ``antonym_hits`` explodes both sides once, keeps the lexicon tokens, joins their entries and
  groups them by pair again. ``rule_decision`` takes this path then:
  a decision depends on the two texts alone, so hits are found per
  distinct pair of texts and joined back by their hashes. Both paths give the same
  answers, with or without a row id and with repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NEG_RULE, lexicon_array, neg_count, strip, tokens_word
from .lexmap import embedded, text_key

# Lexicon tables up to this many rows are broadcast in the join path.
BROADCAST_LEXICON_LIMIT = 2_000_000


def antonym_lexicon(rows: DataFrame, seq: str = "seq", word: str = "word", antonym: str = "antonym") -> DataFrame:
    """Bidirectional lexicon ``(word, antonym, word_pos, anto_pos)``.

    ``rows`` holds the CSV rows with an explicit row order ``seq``. Each row
    adds word->antonym at position 2*seq and antonym->word at 2*seq+1;
    ``word_pos`` is the first position at which ``word`` became a key.
    Entries are stripped, not lowercased; duplicates are kept.
    """
    both = rows.select(
        F.posexplode(
            F.array(
                F.struct(strip(word).alias("w"), strip(antonym).alias("a")),
                F.struct(strip(antonym).alias("w"), strip(word).alias("a")),
            )
        ).alias("side", "e"),
        F.col(seq).cast("long").alias("seq"),
    ).select(
        F.col("e.w").alias("word"),
        F.col("e.a").alias("antonym"),
        (F.col("seq") * 2 + F.col("side")).alias("anto_pos"),
    )
    first = both.groupBy("word").agg(F.min("anto_pos").alias("word_pos"))
    return both.join(first, "word").select("word", "antonym", "word_pos", "anto_pos")


def _adjacent_neg(target: Column, toks: Column, neg: Column, window: int = 2) -> Column:
    """Negation within ``window`` tokens of the first occurrence of target."""
    p = F.array_position(toks, target).cast("int")
    start = F.greatest(p - window, F.lit(1))
    left = F.slice(toks, start, p - start)
    right = F.slice(toks, p + 1, F.lit(window))
    return (p > 0) & F.exists(F.concat(left, right), lambda t: F.array_contains(neg, t))


def _info_has(info: Column, t: Column) -> Column:
    return F.exists(info, lambda x: x["tok"] == t)


def _info_adj(info: Column, t: Column) -> Column:
    return F.exists(info, lambda x: (x["tok"] == t) & x["adj"])


ENTRY = ("word", "antonym", "anto_lemma", "word_pos", "anto_pos")


def lexicon_forms(lexicon: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """(form, word, antonym, anto_lemma, word_pos, anto_pos): each entry once per form of its word.

    ``lemmas`` has (word, lemma), of any size; a word without a lemma is its own, of several the smallest counts.
    """
    if lemmas is None:
        return lexicon.select(F.col("word").alias("form"), "word", "antonym", F.col("antonym").alias("anto_lemma"), "word_pos", "anto_pos")
    one = lemmas.groupBy(F.col("word").alias("__of")).agg(F.min("lemma").alias("__lemma"))

    def with_lemma(df: DataFrame, word: str, out: str) -> DataFrame:
        return df.join(one, F.col(word) == F.col("__of"), "left").withColumn(out, F.coalesce("__lemma", word)).drop("__of", "__lemma")

    entries = lexicon.select("word", "antonym", "word_pos", "anto_pos")
    entries = with_lemma(with_lemma(entries, "word", "__word_lemma"), "antonym", "anto_lemma")
    return entries.select(F.explode(F.array_distinct(F.array("word", "__word_lemma"))).alias("form"), *ENTRY)


def _pair_hits(ref_i: Column, mt_i: Column, n_ref: Column, n_mt: Column, by_lemma: bool) -> Column:
    """The hits of a pair from both sides' lexicon tokens (array<struct<tok, entries, adj>>)."""

    def in_mt(e: Column) -> Column:
        surface = _info_has(mt_i, e["antonym"])
        return surface | _info_has(mt_i, e["anto_lemma"]) if by_lemma else surface

    def own(r: Column, e: Column) -> Column:
        """An entry under the lemma counts there only if the word itself is not in the reference."""
        return (r["tok"] == e["word"]) | ~_info_has(ref_i, e["word"])

    def answered(antonym: Column) -> Column:
        return F.exists(ref_i, lambda x: (x["tok"] == antonym) & F.exists(x["entries"], lambda y: (y["word"] == antonym) & _info_has(ref_i, y["antonym"])))

    def crossed(r: Column, e: Column) -> Column:
        def both(x: Column) -> Column:
            held = _info_has(mt_i, x["antonym"]) & _info_has(ref_i, x["antonym"])
            return (x["word"] == e["word"]) & held & answered(x["antonym"]) if by_lemma else held

        return F.exists(r["entries"], both)

    def flags(r: Column, e: Column) -> Column:
        mt_has = _info_adj(mt_i, e["antonym"]) | _info_adj(mt_i, e["word"])
        ref_has = _info_adj(ref_i, e["word"]) | _info_adj(ref_i, e["antonym"])
        return F.struct(
            e["word"].alias("word"), e["antonym"].alias("antonym"), e["word_pos"].alias("word_pos"), e["anto_pos"].alias("anto_pos"),
            (mt_has != ref_has).alias("adjacent"), crossed(r, e).alias("cross"),
        )

    def value(h: Column) -> Column:
        return F.when(h["cross"], F.lit(1)).when(n_mt == n_ref, F.lit(0)).when(h["adjacent"], F.lit(1)).cast("int")

    def of_token(r: Column) -> Column:
        met = F.filter(r["entries"], lambda e: in_mt(e) & own(r, e) if by_lemma else in_mt(e))
        return F.transform(F.transform(met, lambda e: flags(r, e)), lambda h: F.struct(
            h["word_pos"].alias("word_pos"), h["anto_pos"].alias("anto_pos"), value(h).alias("v"), h["word"].alias("word"),
            h["antonym"].alias("antonym"), h["adjacent"].alias("adjacent"), h["cross"].alias("cross")))

    return F.flatten(F.transform(ref_i, of_token))


FEW_WORDS = 64  # forms of a lexicon that a set operation finds among a row's tokens


def _embedded_forms(forms: DataFrame, limit: int | None):
    fields = [(name, "bigint" if name.endswith("_pos") else "string") for name in ENTRY]
    return embedded(forms, "form", fields, ["word_pos", "anto_pos"], limit)


def _hits_in_row(df: DataFrame, lookup, negations: Iterable[str], ref: str, mt: str, split_danda: bool, by_lemma: bool, all_flags: bool = True) -> tuple[DataFrame, Column]:
    """``df`` with both sides' tokens, negation counts (__n_ref, __n_mt) and lexicon tokens, and the hits from them.

    Without ``all_flags`` a pair with equal counts gets no adjacency: the values of its hits do not depend on it."""
    neg = lexicon_array(negations)
    ref_t, mt_t = F.col("__ref_t"), F.col("__mt_t")

    def known(toks: Column) -> Column:
        """The distinct lexicon tokens of a side with their entries."""
        few = len(lookup.words) <= FEW_WORDS
        mine = F.array_intersect(toks, lexicon_array(lookup.words)) if few else F.array_distinct(toks)
        found = F.transform(mine, lambda t: F.struct(t.alias("tok"), lookup(t).alias("entries")))
        return F.filter(found, lambda x: x["entries"].isNotNull())

    def near(token: Column, toks: Column) -> Column:
        flag = _adjacent_neg(token, toks, neg)
        return flag if all_flags else F.when(F.col("__n_ref") != F.col("__n_mt"), flag).otherwise(F.lit(False))

    def with_flags(found: Column, toks: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["tok"].alias("tok"), x["entries"].alias("entries"), near(x["tok"], toks).alias("adj")))

    staged = df.withColumns({"__ref_t": tokens_word(ref, split_danda), "__mt_t": tokens_word(mt, split_danda)})
    staged = staged.withColumns({"__n_ref": neg_count(ref_t, negations), "__n_mt": neg_count(mt_t, negations), "__ref_k": known(ref_t), "__mt_k": known(mt_t)})
    staged = staged.withColumns({"__ref_i": with_flags(F.col("__ref_k"), ref_t), "__mt_i": with_flags(F.col("__mt_k"), mt_t)})
    return staged, _pair_hits(F.col("__ref_i"), F.col("__mt_i"), F.col("__n_ref"), F.col("__n_mt"), by_lemma)


def rule_decision(
    df: DataFrame,
    lexicon: DataFrame,
    negations: Iterable[str] = NEG_RULE,
    ref: str = "ref",
    mt: str = "mt",
    out: str = "d_rule",
    split_danda: bool = False,
    limit: int | None = None,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Add ``out`` (int, nullable): 0 penalty, 1 reward, null no trigger.

    ``limit``: the most lexicon rows (by form) that are embedded; it picks the plan, never the answer.
    ``lemmas``: (word, lemma); hits are then found by lemma too.
    """
    lookup = _embedded_forms(lexicon_forms(lexicon, lemmas), limit)
    if lookup is None:
        return _rule_decision_join(df, lexicon, negations, ref, mt, out, split_danda, lemmas)
    n_ref, n_mt = F.col("__n_ref"), F.col("__n_mt")
    staged, hits = _hits_in_row(df, lookup, negations, ref, mt, split_danda, lemmas is not None, all_flags=False)
    # the written hits are a column of their own: they are read twice
    staged = staged.withColumn("__w", F.array_sort(F.filter(hits, lambda h: h["v"].isNotNull())))
    start = F.when(n_mt != n_ref, F.lit(0))
    result = F.when(F.size("__w") > 0, F.element_at(F.col("__w"), -1)["v"]).otherwise(start).cast("int")
    return staged.withColumn(out, result).drop("__ref_t", "__mt_t", "__n_ref", "__n_mt", "__ref_k", "__mt_k", "__ref_i", "__mt_i", "__w")


def _near_negation(toks: str, negations: Iterable[str]) -> Column:
    """Per position whether a negation stands within two tokens of it."""
    neg = lexicon_array(negations)
    around = [F.lit(False), F.lit(False)]
    padded = F.concat(F.array(*around), F.transform(toks, lambda t: F.array_contains(neg, t)), F.array(*around))
    shifted = [F.slice(padded, k, F.size(toks)) for k in (1, 2, 4, 5)]
    return F.transform(F.arrays_zip(*[x.alias(f"n{k}") for k, x in enumerate(shifted)]), lambda x: x["n0"] | x["n1"] | x["n2"] | x["n3"])


def antonym_hits(
    df: DataFrame,
    lexicon: DataFrame,
    negations: Iterable[str] = NEG_RULE,
    key: str = "row_id",
    ref: str = "ref",
    mt: str = "mt",
    split_danda: bool = False,
    lemmas: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One row per hit: key, word, antonym, word_pos, anto_pos, n_ref, n_mt,
    neg_adjacent, cross_antonym, v (the value the hit writes, or null).

    Rows equal in key and texts give their hits once. ``limit``: as for ``rule_decision``."""
    forms = lexicon_forms(lexicon, lemmas)
    lookup = _embedded_forms(forms, limit)
    if lookup is not None:
        pairs = df.select(F.struct(F.col(key).alias("key"), text_key(ref, mt).alias("text")).alias("__k"), F.col(ref).alias("__ref"), F.col(mt).alias("__mt"))
        staged, hits = _hits_in_row(pairs, lookup, negations, "__ref", "__mt", split_danda, lemmas is not None)
        found = staged.select("__k", F.col("__n_ref").alias("n_ref"), F.col("__n_mt").alias("n_mt"), F.explode(hits).alias("h"))
        return _hit_rows(found.select("__k", "n_ref", "n_mt", "h.*").distinct(), key)
    entries = forms.groupBy("form").agg(F.collect_list(F.struct(*ENTRY)).alias("entries"))
    if forms.limit(BROADCAST_LEXICON_LIMIT + 1).count() <= BROADCAST_LEXICON_LIMIT:
        entries = F.broadcast(entries)
    staged = df.select(
        F.struct(F.col(key).alias("key"), text_key(ref, mt).alias("text")).alias("__k"),
        tokens_word(ref, split_danda).alias("__ref_t"), tokens_word(mt, split_danda).alias("__mt_t"),
    )
    near = {"__ref_n": _near_negation("__ref_t", negations), "__mt_n": _near_negation("__mt_t", negations)}
    staged = staged.withColumns({"n_ref": neg_count(F.col("__ref_t"), negations), "n_mt": neg_count(F.col("__mt_t"), negations), **near})

    def placed(side: str) -> Column:
        return F.zip_with(f"__{side}_t", f"__{side}_n", lambda t, n: F.struct(F.lit(side).alias("side"), t.alias("tok"), n.alias("near")))

    pair = ["__k", "n_ref", "n_mt"]
    # outer: an inferred filter on the array's size would evaluate the tokens once per element
    rows = staged.select(*pair, F.posexplode_outer(F.concat(placed("ref"), placed("mt"))).alias("pos", "x"))
    rows = rows.select(*pair, "pos", "x.side", F.col("x.tok").alias("form"), "x.near")
    first = rows.join(entries.select("form"), "form", "left_semi").groupBy(*pair, "side", "form").agg(F.min_by("near", "pos").alias("adj"))
    info = F.struct(F.col("form").alias("tok"), "entries", "adj")
    sides = first.join(entries, "form").groupBy(*pair).agg(*(F.collect_list(F.when(F.col("side") == s, info)).alias(f"__{s}_i") for s in ("ref", "mt")))
    hits = _pair_hits(F.col("__ref_i"), F.col("__mt_i"), F.col("n_ref"), F.col("n_mt"), lemmas is not None)
    return _hit_rows(sides.select(*pair, F.explode(hits).alias("h")).select(*pair, "h.*"), key)


def _hit_rows(hits: DataFrame, key: str) -> DataFrame:
    return hits.select(
        F.col("__k.key").alias(key), "word", "antonym", "word_pos", "anto_pos", "n_ref", "n_mt",
        F.col("adjacent").alias("neg_adjacent"), F.col("cross").alias("cross_antonym"), "v",
    )


def _rule_decision_join(df, lexicon, negations, ref, mt, out, split_danda, lemmas):
    pairs = df.select(text_key(ref, mt).alias("__t"), F.col(ref).alias("__ref"), F.col(mt).alias("__mt")).dropDuplicates(["__t"])
    hits = antonym_hits(pairs, lexicon, negations, "__t", "__ref", "__mt", split_danda, lemmas, limit=0)
    per_text = hits.where(F.col("v").isNotNull()).groupBy("__t").agg(F.max_by("v", F.struct("word_pos", "anto_pos")).alias("__hit_v"))
    start = F.when(neg_count(tokens_word(ref, split_danda), negations) != neg_count(tokens_word(mt, split_danda), negations), F.lit(0))
    keyed = df.withColumn("__key", text_key(ref, mt))
    return keyed.join(per_text, F.col("__key") == F.col("__t"), "left").withColumn(out, F.coalesce(F.col("__hit_v"), start).cast("int")).drop("__hit_v", "__key", "__t")
