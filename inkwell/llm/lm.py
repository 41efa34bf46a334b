"""Language-model scores from a weighted backoff automaton that is learned on Spark.

The model is a trigram model, each order smoothed towards the one below with a Dirichlet prior of weight m1 and m2:

    P(w)       = (c(w) + 1) / (N + V + 1)
    P(w | v)   = (c(v w) + m1 P(w)) / (c(v) + m1)
    P(w | u v) = (c(u v w) + m2 P(w | v)) / (c(u v) + m2)

The weights come from the training counts alone: with one occurrence left out, the priors must take as much probability as
there are n-grams that occur once (``prior_weight``).  No held-out text has a part in them.

As an automaton: the root has an arc for every word; each known word v and each known pair u v is a state; its arcs are the
n-grams seen after it, each with the smoothed log-probability of its word, and they lead to the state of the longest known
history.  For any other word a state has a failure arc, of weight m / (c + m), to the state with one word less.  One
left-to-right traversal of a text carries the state, follows arcs and failure arcs, and adds up log-probabilities.

Counts cover all training documents and are never cut.  Texts are handled in blocks; each gets the whole-corpus counts of
its own n-grams (see ``ngram_counts``) and builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, mix, table, text_bytes, words
from .ngram_counts import SHORT, WHOLE, block_counts, numbered, prior_weight, shards_for, told, total_of

#: Tokens that one walker reads; a longer text is read by several at once.
WALK = 512
END = np.uint64(0x0E4D0E4D0E4D0E4D)
START = np.uint64(0x57A27B0057A27B00)


class Block:
    """The tokens of a block's texts and its distinct words, pairs and triples (by sorted hashes).

    A text's tokens are its words and one end; its first history is a start.  ``word_at`` and so on tell, for each token, the
    word, pair or triple that ends with it; the first token of a text has no triple (-1).
    """

    def __init__(self, texts: pa.ChunkedArray):
        h, _, count = words(*text_bytes(texts.combine_chunks()))
        self.sizes = count + 1
        self.last = np.cumsum(self.sizes) - 1
        self.first = self.last - self.sizes + 1
        token = np.empty(int(self.sizes.sum()), np.uint64)
        inner = np.ones(len(token), bool)
        inner[self.last] = False
        token[inner], token[self.last] = h, END
        self.row = np.repeat(np.arange(len(count)), self.sizes)
        history = np.empty_like(token)
        history[1:] = token[:-1]
        history[self.first] = START
        self.opens = np.zeros(len(token), bool)
        self.opens[self.first] = True
        with np.errstate(over="ignore"):
            pair = mix(history * np.uint64(0x9E3779B97F4A7C15) + token)
            before = np.empty_like(pair)
            before[1:] = pair[:-1]
            triple = mix(before * np.uint64(0xD6E8FEB86659FD93) + token)[~self.opens]
        del history, before
        self.words, self.word_at = np.unique(token, return_inverse=True)
        self.pairs, self.pair_first, self.pair_at = np.unique(pair, return_index=True, return_inverse=True)
        self.triples, where, at = np.unique(triple, return_index=True, return_inverse=True)
        self.triple_at = np.full(len(token), -1, np.int64)
        self.triple_at[~self.opens] = at
        self.triple_first = np.flatnonzero(~self.opens)[where]

    def kinds(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.words, self.word_at), (self.pairs, self.pair_at), (self.triples, self.triple_at)]


def training_counts(part: pa.Table, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """A block's distinct n-grams with their counts in training texts (0: only other texts of the block hold it)."""
    block = Block(part[text])
    training = ~part["held_out"].to_numpy().astype(bool)[block.row]
    out = []
    for keys, at in block.kinds():
        whole = at >= 0
        out.append((keys, np.bincount(at[whole], weights=training[whole], minlength=len(keys)).astype(np.int64)))
    return out


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States: 0 is the root, then the start, the words and the pairs that training texts hold.  ``fail`` and ``fail_weight``
    are the failure arcs (the root has none); the other arcs are sorted by (state, word).  All weights are log10.
    """

    def __init__(self, block: Block, words_: np.ndarray, pairs: np.ndarray, triples: np.ndarray, tokens: int, vocabulary: int, documents: int, mu: tuple[float, float]):
        self.width = len(words_)
        root = (words_ + 1) / (tokens + vocabulary + 1)
        self.root_weight = np.log10(root)
        # States: which words and pairs are known.
        known_word, known_pair = np.flatnonzero(words_ > 0), np.flatnonzero(pairs > 0)
        self.of_word = np.zeros(len(words_), np.int64)
        self.of_word[known_word] = 2 + np.arange(len(known_word))
        of_pair = np.zeros(len(pairs), np.int64)
        of_pair[known_pair] = 2 + len(known_word) + np.arange(len(known_pair))
        self.start = 1
        seen = np.concatenate([[0, documents], words_[known_word], pairs[known_pair]]).astype(np.float64)
        self.fail = np.zeros(len(seen), np.int64)
        ends = block.word_at[block.pair_first]  # last word of each pair
        self.fail[2 + len(known_word) :] = self.of_word[ends[known_pair]]
        prior = np.concatenate([np.full(2 + len(known_word), mu[0]), np.full(len(known_pair), mu[1])])
        self.fail_weight = np.log10(prior / (seen + prior))
        # Arcs: pairs leave the state of their first word, triples that of their first pair; both lead to a pair's state.
        at = block.pair_first[known_pair]
        opens = block.opens[at]
        source = np.where(opens, self.start, self.of_word[block.word_at[at - 1]])
        chance = np.zeros(len(pairs))
        chance[known_pair] = (pairs[known_pair] + mu[0] * root[ends[known_pair]]) / (seen[source] + mu[0])
        known_triple = np.flatnonzero(triples > 0)
        last = block.triple_first[known_triple]
        source2, then = of_pair[block.pair_at[last - 1]], block.pair_at[last]
        chance2 = (triples[known_triple] + mu[1] * chance[then]) / (seen[source2] + mu[1])
        keys = np.concatenate([source * self.width + ends[known_pair], source2 * self.width + block.word_at[last]])
        order = np.argsort(keys)
        self.arcs = keys[order]
        self.arc_weight = np.log10(np.concatenate([chance[known_pair], chance2]))[order]
        self.arc_to = np.concatenate([of_pair[known_pair], of_pair[then]])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word from each state: the states reached and the weights of the arcs taken."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            own = state[left]
            key = own * self.width + word[left]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = (self.arcs[at] == key) & (own > 0) if len(self.arcs) else np.zeros(len(left), bool)
            weight[left[hit]] += self.arc_weight[at[hit]]
            to[left[hit]] = self.arc_to[at[hit]]
            root = left[own == 0]
            weight[root] += self.root_weight[word[root]]
            to[root] = self.of_word[word[root]]
            left = left[~hit & (own > 0)]
            weight[left] += self.fail_weight[state[left]]
            state = state.copy()
            state[left] = self.fail[state[left]]
        return to, weight

    def traverse(self, block: Block) -> np.ndarray:
        """log10 probability of each text.

        All texts are read at once, one token of each in a step.  A long text is read by several walkers: a state tells no
        more than the last two tokens, so one that starts two tokens ahead of its part, at the root, is in the right state
        when it gets there.
        """
        runs = -(-block.sizes // WALK)
        row = np.repeat(np.arange(len(runs)), runs)
        part = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = block.first[row] + part * WALK
        stop = np.minimum(begin + WALK, block.last[row] + 1)
        at = np.where(part > 0, begin - 2, begin)
        order = np.argsort(at - stop, kind="stable")  # longest first, so that those still walking are a prefix
        row, begin, stop, at = row[order], begin[order], stop[order], at[order]
        state, total = np.where(part[order] > 0, 0, self.start), np.zeros(len(row))
        length = stop - at
        for i in range(int(length.max(initial=0))):
            on = int(np.searchsorted(-length, -i, side="left"))
            state[:on], weight = self.step(state[:on], block.word_at[at[:on] + i])
            total[:on] += np.where(at[:on] + i >= begin[:on], weight, 0.0)
        return np.bincount(row, weights=total, minlength=len(runs))


def score_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, mu: tuple[float, float] | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from rows whose crc32 (of the key as text) modulo ``folds`` is not ``held``; a row with a null key is held out.
    ``mu``: weights of the priors; worked out from the training counts if they aren't given.
    A null or empty text is its end token alone; a text of any length is read whole.  Repeated rows count as often as they
    stand there.  If nothing is left to learn from, every token has the probability 1 (N = V = 0).  An empty table gives
    no rows.  Other columns are not looked at.  ``docs`` is read twice and must give the same rows in the same order each
    time, as stored tables do.
    """
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(True))
    docs = docs.select(key, text, held_out.alias("held_out"))
    size, documents = docs.agg(F.sum(F.octet_length(text)), F.count(F.when(~F.col("held_out"), 1))).first()
    shards = shards_for((size or 0) * 0.12)  # about an n-gram of each kind for eight bytes
    kind = docs.schema[key].dataType.simpleString()
    answers = block_counts(docs, text, lambda part: training_counts(part, text), [WHOLE, SHORT, SHORT], shards, "counts")
    vocabulary, tokens = total_of(answers, 0)
    mu = mu or (prior_weight(answers, 0), prior_weight(answers, 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            raise RuntimeError("the input changed while it was read")
        block = Block(left[text])
        word, pair, triple = (told(right, i, keys, shards) for i, (keys, _) in enumerate(block.kinds()))
        automaton = Automaton(block, word, pair, triple, tokens, vocabulary, documents, mu)
        rows = len(block.sizes)
        base = np.bincount(block.row, weights=automaton.root_weight[block.word_at], minlength=rows)
        known = np.bincount(block.row, weights=word[block.word_at] > 0, minlength=rows).astype(np.int64)
        out = pa.table({key: left[key], "held_out": left["held_out"], "n_tokens": block.sizes, "n_known": known, "train_tokens": np.full(rows, tokens), "base_score": base, "score": automaton.traverse(block)})
        del block, automaton
        give_back()
        return out

    right = answers.select("block", "shard", "kind", "totals")
    texts = numbered(docs, text).groupBy("block").cogroup(right.groupBy("block"))
    return texts.applyInArrow(score, f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
