"""Language-model scores: likelihood over a subword lattice.

The pieces and their scores come from an existing subword vocabulary. A text is
its words, each led by the word mark, and one end symbol. Every way to cut a
word into pieces is a path of a lattice whose edges weigh the pieces'
probabilities; the forward recursion in log space sums all paths, so a text's
score is its marginal probability, not that of a best segmentation. Pieces do
not cross words, so a word's marginal is worked out once for the whole corpus.

Piece probabilities: the vocabulary's own scores (ranks) give a prior that falls
with the rank; a few expectation steps over the counted words of the training
documents give expected uses of each piece; both are mixed, the prior by a share
that doesn't fall as the corpus grows. Characters that are
no piece are spelt by the vocabulary's byte pieces, so that every text has a
positive probability.

Distribution: word counts are gathered over all documents by map-side counting
and one shuffle. Words found often (at most ``FREQUENT`` of them) are sent to all
tasks and scored where the text is; the rest, which can't be hot, meet the word
table in a shuffle join. Nothing else is collected but two totals, a histogram
of 64 rows and one expected count per piece of the vocabulary.

Defined cases: null text counts as empty: the end symbol alone; with no training
documents every count is 0 and the prior alone scores; repeated rows are scored
each; words of any length are scored whole, in memory that doesn't grow with them
beyond the text itself (training keeps eight bytes a character).
"""

from __future__ import annotations

import functools
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import give_back, materialize, parts_of, texts_of

MARK = "▁"
#: Words sent to all tasks at most.
FREQUENT = 1 << 17
#: Weight of the prior: so many pieces, or this share of all uses where that is more, so that it counts in corpora of any size.
PRIOR_PIECES, PRIOR_SHARE = 20_000.0, 0.05
#: Words that a task counts before it hands the counts on.
COUNTED_WORDS = 400_000
#: Expectation steps over the word counts.
ROUNDS = 2
#: Words of up to so many characters go through the recursion side by side, so many at a time.
SHORT_WORD, SIDE_BY_SIDE = 48, 1024
LOG10 = math.log(10)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> tuple[dict[str, int], list[int], np.ndarray]:
    """(piece to number, numbers of the 256 byte pieces, prior probabilities); the end symbol is the last number."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces: dict[str, int] = {}
    scores: list[float] = []
    spelt = [0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        if sp.is_byte(i):
            spelt[int(sp.id_to_piece(i)[3:5], 16)] = len(scores)
            scores.append(-math.inf)
        else:
            pieces[sp.id_to_piece(i)] = len(scores)
            scores.append(sp.get_score(i))
    score = np.array([*scores, -math.inf])
    # scores of this vocabulary fall by one a rank: frequency falls about as one over the rank
    prior = np.where(np.isfinite(score), 1 / (10 - np.minimum(0, np.where(np.isfinite(score), score, 0))), 0)
    prior[~np.isfinite(score)] = 0.02 * prior.sum() / 257
    return pieces, spelt, prior / prior.sum()


class Lattice:
    """Edges of a word's lattice, weighed by the logarithms of piece probabilities."""

    def __init__(self, log_p: np.ndarray, path: str | None = None):
        pieces, self.spelt, _ = vocabulary(path)
        self.log_p = log_p.tolist()
        self.edge = {piece: (n, self.log_p[n]) for piece, n in pieces.items()}
        self.longest = max(map(len, pieces))
        self.loose: dict[str, tuple[tuple[int, ...], float]] = {}

    def spell(self, char: str) -> tuple[tuple[int, ...], float]:
        if char not in self.loose:
            numbers = tuple(self.spelt[b] for b in char.encode("utf-8", "surrogatepass"))
            self.loose[char] = numbers, sum(self.log_p[n] for n in numbers)
        return self.loose[char]

    def into(self, text: str, j: int) -> list[tuple[int, tuple[int, ...] | int, float]]:
        """The edges that end at position ``j`` of a marked word: (start, piece or byte pieces, log probability)."""
        get = self.edge.get
        found = [(i, *e) for i in range(max(0, j - self.longest), j) if (e := get(text[i:j])) is not None]
        if text[j - 1] not in self.edge:
            found.append((j - 1, *self.spell(text[j - 1])))
        return found

    def forward(self, text: str) -> Iterator[float]:
        """Log marginals of the marked word's prefixes, shortest first; no more of them are kept than a piece is long."""
        exp, log, wide = math.exp, math.log, self.longest + 1
        last = [0.0] * wide
        yield 0.0
        for j in range(1, len(text) + 1):
            terms = [last[i % wide] + w for i, _, w in self.into(text, j)]
            if len(terms) == 1:
                value = terms[0]
            else:
                top = max(terms)
                value = top + log(sum([exp(t - top) for t in terms]))
            last[j % wide] = value
            yield value

    def log_marginal(self, word: str) -> float:
        value = 0.0
        for value in self.forward(MARK + word):  # noqa: B007
            pass
        return value

    def expect(self, word: str, times: float, total: list[float]) -> None:
        """Add the expected uses of each piece in ``times`` occurrences of the word; eight bytes a character are kept."""
        text, exp, wide = MARK + word, math.exp, self.longest + 1
        alpha = array("d", self.forward(text))
        beta = [0.0] * wide  # weight of the paths through a position, relative to all, for the positions that are still open
        beta[len(text) % wide] = times
        for j in range(len(text), 0, -1):
            b, beta[j % wide] = beta[j % wide], 0.0
            if b <= 0.0:
                continue
            aj = alpha[j]
            for i, piece, w in self.into(text, j):
                use = b * exp(alpha[i] + w - aj)
                beta[i % wide] += use
                if piece.__class__ is int:
                    total[piece] += use
                else:
                    for p in piece:
                        total[p] += use


class PieceTable:
    """Pieces by a hash of their characters: two tables, the second for those whose place in the first is taken."""

    BITS = 20
    _MIX = np.uint64(0x9E3779B97F4A7C15)
    SEED = np.uint64(1)  # not 0, which U+0000 would leave as it is

    def __init__(self, pieces: dict[str, int]):
        self.first, self.second = (np.full(1 << self.BITS, -1, np.int32) for _ in range(2))
        self.hashes = np.zeros(max(pieces.values(), default=0) + 2, np.uint64)
        wide = max(map(len, pieces), default=0)
        code = np.array([[*map(ord, p), *[0] * (wide - len(p))] for p in pieces], np.uint64).reshape(len(pieces), wide)
        size, number = np.array([len(p) for p in pieces], np.int64), np.array(list(pieces.values()), np.int64)
        h = np.full(len(pieces), self.SEED, np.uint64)
        for k in range(wide):
            h = self.step(h, code[:, k])
            self.hashes[number[size == k + 1]] = h[size == k + 1]
        for n in pieces.values():
            h = self.hashes[n]
            for table, place in ((self.first, self.high(h)), (self.second, self.low(h))):
                if table[place] < 0:
                    table[place] = n
                    break
            else:
                raise ValueError("two tables don't hold this vocabulary")

    def step(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * self._MIX
        return h ^ (h >> np.uint64(31))

    def high(self, h):
        return h >> np.uint64(64 - self.BITS)

    def low(self, h):
        return h & np.uint64((1 << self.BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        n = self.first[self.high(h)]
        n = np.where((n >= 0) & (self.hashes[n] == h), n, -1)
        m = self.second[self.low(h)]
        return np.where((m >= 0) & (self.hashes[m] == h), m, n)


@functools.lru_cache(maxsize=2)
def piece_table(path: str | None = None) -> PieceTable:
    return PieceTable(vocabulary(path)[0])


class WordLattices:
    """The lattices of many words at once; longer words go one by one."""

    def __init__(self, log_p: np.ndarray, path: str | None = None):
        self.one, self.table, self.log_p = Lattice(log_p, path), piece_table(path), log_p
        self.longest = self.one.longest

    def _chunks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of the words, their lengths with the mark, their characters) of short words of like length."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= SHORT_WORD]
        for k in range(0, len(order), SIDE_BY_SIDE):
            at = order[k : k + SIDE_BY_SIDE]
            n, wide = size[at] + 1, int(size[at[-1]]) + 1
            code = np.zeros((len(at), wide), np.uint64)
            flat = np.frombuffer("".join([MARK + words[i] for i in at.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
            code[np.arange(wide) < n[:, None]] = flat
            yield at, n, code

    def _edges(self, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, log probability) by word, start and length - 1, and where a character is spelt by bytes."""
        rows, wide = code.shape
        most = min(self.longest, wide)
        piece = np.full((rows, wide, most), -1, np.int32)
        h = np.full_like(code, self.table.SEED)
        for k in range(most):
            h = self.table.step(h[:, : wide - k], code[:, k:])
            piece[:, : wide - k, k] = self.table.find(h)
        found = np.flatnonzero((piece >= 0).any((0, 1)))
        piece = piece[:, :, : max(1, found[-1] + 1 if len(found) else 1)]  # no longer piece occurs in these words
        weight = np.where(piece >= 0, self.log_p[piece], -np.inf)
        loose = (piece[:, :, 0] < 0) & (np.arange(wide) < n[:, None])
        if loose.any():
            chars, which = np.unique(code[loose], return_inverse=True)
            weight[:, :, 0][loose] = np.array([self.one.spell(chr(int(c)))[1] for c in chars])[which.ravel()]
        return piece, weight, loose

    def _forward(self, weight: np.ndarray) -> np.ndarray:
        """Log marginals of all prefixes; minus infinity past a word's end."""
        rows, wide, most = weight.shape
        alpha = np.full((rows, wide + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, wide + 1):
            k = np.arange(1, min(j, most) + 1)
            terms = alpha[:, j - k] + weight[:, j - k, k - 1]
            top = terms.max(1)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[:, j] = safe + np.log(np.exp(terms - safe[:, None]).sum(1))
        return alpha

    def log_marginals(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, n, code in self._chunks(words):
            out[at] = self._forward(self._edges(code, n)[1])[np.arange(len(at)), n]
        for i, w in enumerate(words):
            if len(w) > SHORT_WORD:
                out[i] = self.one.log_marginal(w)
        return out

    def expect(self, words: list[str], times: np.ndarray, total: np.ndarray) -> None:
        """Add the expected uses of each piece in ``times`` occurrences of the words."""
        for at, n, code in self._chunks(words):
            piece, weight, loose = self._edges(code, n)
            alpha = self._forward(weight)
            rows, wide, most = weight.shape
            beta = np.zeros((rows, wide + 1))
            beta[np.arange(rows), n] = times[at]
            use = np.zeros_like(weight)
            finite = np.where(np.isfinite(alpha), alpha, 0)
            for j in range(wide, 0, -1):
                k = np.arange(1, min(j, most) + 1)
                part = np.exp(alpha[:, j - k] + weight[:, j - k, k - 1] - finite[:, j, None]) * beta[:, j, None]
                use[:, j - k, k - 1] = part
                beta[:, j - k] += part
            found = piece >= 0
            total += np.bincount(piece[found], use[found], len(total))
            if loose.any():
                chars, which = np.unique(code[loose], return_inverse=True)
                for c, u in zip(chars.tolist(), np.bincount(which.ravel(), use[:, :, 0][loose], len(chars)).tolist(), strict=True):
                    for number in self.one.spell(chr(c))[0]:
                        total[number] += u
        rest = [0.0] * len(total)
        long_ones = [(w, t) for w, t in zip(words, times.tolist(), strict=True) if len(w) > SHORT_WORD]
        for w, t in long_ones:
            self.one.expect(w, t, rest)
        if long_ones:
            total += np.array(rest)


def count_words(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """(word, c, n): occurrences in training documents and in all; the null word stands for the end symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt: Counter = Counter()
        others: Counter = Counter()

        def handed() -> pa.RecordBatch:
            words = list(learnt.keys() | others.keys())
            c = [learnt[w] for w in words]
            n = [k + others[w] for k, w in zip(c, words, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") if w is not None else None for w in words], pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])

        for batch in batches:
            for text, train in zip(texts_of(batch, 0), batch.column(1).to_pylist(), strict=True):
                counter = learnt if train else others
                counter.update(text.encode("utf-8", "surrogatepass").lower().split())
                counter[None] += 1
                if len(learnt) + len(others) > COUNTED_WORDS:
                    yield handed()
                    learnt.clear()
                    others.clear()
        if learnt or others:
            yield handed()
        learnt.clear()
        others.clear()
        give_back()

    parts = docs.select(F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("train")).mapInArrow(run, "word string, c bigint, n bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def piece_probabilities(words: DataFrame, ends: int, path: str | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of all pieces and the end symbol after ``rounds`` expectation steps over (word, c)."""
    prior = vocabulary(path)[2]
    log_p = np.log(prior)

    def step(log_p: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattices, total = WordLattices(log_p, path), np.zeros(len(prior))
            for batch in batches:
                lattices.expect(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64), total)
            del lattices
            give_back()
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])

        found = words.select("word", "c").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.zeros(len(prior))
        for r in found.collect():  # one row per piece of the vocabulary at most
            uses[r["piece"]] += r["uses"]
        uses[-1] += ends
        uses += max(PRIOR_PIECES, PRIOR_SHARE * uses.sum()) * prior
        return np.log(uses / uses.sum())

    for _ in range(rounds):
        log_p = step(log_p)
    return log_p


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score (add-one word unigram) and score (lattice), log10.

    ``learn`` says which rows are training documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counted = materialize(count_words(docs, id_col, text_col, learn), "words")
    totals = counted.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.max(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    train_tokens, distinct, ends = totals["n"] or 0, totals["v"] or 0, totals["ends"] or 0
    log_p = piece_probabilities(counted.filter("word is not null and c > 0"), ends, vocabulary_path)

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = WordLattices(log_p, vocabulary_path)
        for batch in batches:
            values = lattices.log_marginals(batch.column(0).to_pylist()) / LOG10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(values)], ["word", "c", "n", "marginal"])
        del lattices
        give_back()

    words = materialize(counted.filter("word is not null").mapInArrow(marginals, "word string, c bigint, n bigint, marginal double"), "marginals")
    # the smallest power of two such that at most FREQUENT words are found more often
    more, exponent = 0, 64
    for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().orderBy(F.desc("e")).collect():
        more += r["count"]
        if more > FREQUENT:
            break
        exponent = r["e"]
    often = 2**exponent if exponent < 63 else (1 << 62)
    known = {r["word"].encode("utf-8", "surrogatepass"): (math.log10(r["c"] + 1), r["marginal"]) for r in words.filter(F.col("n") >= often).collect()}
    frequent = docs.sparkSession.sparkContext.broadcast(known)
    end = math.log10(ends + 1), float(log_p[-1]) / LOG10
    base_total = math.log10(train_tokens + distinct + 1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        row = TaskContext.get().partitionId() << 40
        names = ["row", "id", "word", "times", "n_tokens", "n_known", "base", "score"]
        for batch in (part for whole in batches for part in parts_of(whole)):
            ids = batch.column(0)
            out: list[list] = [[] for _ in names[2:]]
            rows: list[int] = []
            of: list[int | None] = []
            rare_row: list[int] = []
            rare_word: list[bytes] = []
            rare_times: list[int] = []
            get = table.get
            for i, text in enumerate(texts_of(batch, 1)):
                words_ = text.encode("utf-8", "surrogatepass").lower().split()
                n_known, base, score = int(end[0] > 0), *end
                for word, times in Counter(words_).items():
                    if (w := get(word)) is not None:
                        base += times * w[0]
                        score += times * w[1]
                        if w[0]:  # a word that was counted
                            n_known += times
                    else:
                        rare_row.append(row)
                        rare_word.append(word)
                        rare_times.append(times)
                rows.append(row)
                of.append(i)
                for column, value in zip(out, (None, None, len(words_) + 1, n_known, base - (len(words_) + 1) * base_total, score), strict=True):
                    column.append(value)
                row += 1
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids, *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names)
            for k in range(0, len(rare_row), 100_000):
                m = len(rare_row[k : k + 100_000])
                none = [pa.nulls(m, t) for t in kinds[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(rare_row[k : k + m], pa.int64()), pa.nulls(m, ids.type), pa.array([w.decode("utf-8", "replace") for w in rare_word[k : k + m]], pa.string()), pa.array(rare_times[k : k + m], pa.int32()), *none], names)
            del out, rows, of, rare_row, rare_word, rare_times
        give_back()

    split = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(parts, f"row bigint, id {kind}, word string, times int, n_tokens bigint, n_known bigint, base double, score double")
    split = materialize(split, "word_parts")
    frequent.destroy()  # written, so no task asks for it again; workers would keep it as long as they live
    rare = split.filter("word is not null").select("row", "word", "times").join(words.filter(F.col("n") < often).select("word", "c", "marginal"), "word")
    times = F.col("times")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("known"),
        F.sum(times * F.log10(F.col("c") + F.lit(1.0))).alias("base_part"),
        F.sum(times * F.col("marginal")).alias("score_part"),
    )
    whole = split.filter("word is null").select("row", "id", "n_tokens", "n_known", "base", "score").join(rare, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(
        F.col("id").alias(id_col),
        "n_tokens",
        add("n_known", "known").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        add("base", "base_part").alias("base_score"),
        add("score", "score_part").alias("score"),
    )
