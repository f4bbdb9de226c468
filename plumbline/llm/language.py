"""Language identification of code-switched text with a linear-chain conditional random field.

States are languages. A word's emission is the sum of learned weights over its affixes, character n-grams and
lexicon entries (features hashed to a fixed table); learned transitions say how seldom a writer switches.
The model is fitted on a bounded sample of labelled documents by stochastic gradients of the exact likelihood
(forward-backward). Whole texts are labelled: words in sequences of up to `SEQUENCE`, lines never joined beyond
that, posterior marginals by forward-backward over all sequences of a batch at once. A document's language is the
one with the largest summed marginal over its lettered words; its share is the score.

Nulls and edges: a null text or one without a letter is `und` with score 0; null languages are not trained on;
ties go to the first language in order. Rows that repeat are predicted each. Without any labelled row every
document is `und`. Empty tables give no rows. Extra columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried as columns_beside

#: Hashed features.
TABLE = 1 << 17
#: Words of a sequence.
SEQUENCE = 64
#: Training: at most so many documents, of at most so many characters each (longer ones are not sampled), and words in all.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WORDS = 2400, 20_000, 300_000
#: A word is in the lexicon if the sample has it so often.
LEXICON_LEAST = 5
#: Words whose emissions a worker remembers.
CACHE = 200_000
#: What is cut off a word's ends, besides white space.
_EDGE = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_K = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)


def core(word: str) -> str:
    """A lower-case word without marks and digits around it; empty if it has no letter."""
    w = word if word.isalpha() else word.strip(_EDGE)
    return w if w.isalpha() or any(c.isalpha() for c in w) else ""


def _slot(tag: int, *parts: np.ndarray) -> np.ndarray:
    """Table row of a feature: its kind and its bytes."""
    h = np.full(len(parts[0]), tag * 0x27D4EB2F, np.uint64)
    for i, x in enumerate(parts):
        h = (h ^ x) * _K[i]
        h ^= h >> np.uint64(17)
    return (h % np.uint64(TABLE)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, table row) of the affixes and n-grams of bare words, all words at once, as UTF-8 bytes."""
    coded = [w.encode() for w in words]
    sizes = np.array([len(x) for x in coded], np.int64)
    if not len(sizes) or not sizes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buffer = np.frombuffer(b"".join(b"^" + x + b"$" for x in coded) + b"\0\0", np.uint8).astype(np.uint64)
    start = np.cumsum(sizes + 2) - sizes - 2
    full = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    left = np.repeat(start + sizes + 2, sizes + 2) - np.arange(len(owner))  # bytes from here to the word's end
    a, b, c = buffer[:-2], buffer[1:-1], buffer[2:]
    two, three = np.flatnonzero((left > 1) & (sizes[owner] > 0)), np.flatnonzero((left > 2) & (sizes[owner] > 0))
    owners, rows = [owner[two], owner[three]], [_slot(1, a[two], b[two]), _slot(2, a[three], b[three], c[three])]
    for k in (1, 2, 3):
        some = full[sizes[full] >= k]
        for tag, first in ((10 + k, start[some] + 1), (20 + k, start[some] + sizes[some] + 1 - k)):
            owners.append(some)
            rows.append(_slot(tag, *(buffer[first + i] for i in range(k))))
    return np.concatenate(owners), np.concatenate(rows)


class Model:
    """Languages, weights (TABLE and lexicon rows x languages), transitions, and the lexicon: word -> row."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: dict[str, int]):
        self.languages, self.weights, self.moves, self.lexicon = languages, weights, moves, lexicon


def forward_backward(emit: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequences, steps, states) and expected transition counts; steps beyond a sequence's length are zero."""
    n, steps, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(moves)
    live = np.arange(steps)[None, :] < lengths[:, None]
    alpha = np.empty_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[:, t - 1] @ m) * e[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones_like(e)
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        x = e[:, t + 1] * beta[:, t + 1]
        on = live[:, t + 1]
        b = x @ m.T
        joint = alpha[on, t].T @ (x[on] / np.maximum((alpha[on, t] * b[on]).sum(axis=1, keepdims=True), 1e-30))
        pairs += joint * m
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(on[:, None], b, 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    return post * live[:, :, None], pairs


def fit(rows: list[tuple[str, str]], epochs: int = 3, batch: int = 64, rate: float = 0.25, decay: float = 1e-5) -> Model:
    """Fit on (text, language) rows; each word of a row has its row's language."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    counts: Counter = Counter()
    sequences: list[tuple[list[str], int]] = []
    total = 0
    for text, lang in rows:
        words = [core(w) for w in text.lower().split()]
        if total > TRAIN_WORDS:
            break
        total += len(words)
        counts.update(words)
        sequences += [(words[i : i + SEQUENCE], languages.index(lang)) for i in range(0, len(words), SEQUENCE)]
    lexicon = {w: TABLE + i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= LEXICON_LEAST and w))}
    size = TABLE + len(lexicon)
    weights, moves = np.zeros((size, max(k, 1))), np.zeros((max(k, 1), max(k, 1)))
    squares, move_squares = np.full(size, 1e-2), np.full(moves.shape, 1e-2)
    vocabulary = {w: i for i, w in enumerate(counts)}
    owner, row = features(list(vocabulary))
    known = np.array([[vocabulary[w], r] for w, r in lexicon.items()], np.int64).reshape(-1, 2)
    owner, row = np.concatenate([owner, known[:, 0]]), np.concatenate([row, known[:, 1]])
    row = row[np.argsort(owner, kind="stable")]
    many = np.bincount(owner, minlength=len(vocabulary))
    begin = np.cumsum(many) - many
    sequences = [(np.array([vocabulary[w] for w in words], np.int64), y) for words, y in sequences]
    rng = np.random.default_rng(7)
    for _ in range(epochs if k else 0):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), batch):
            some = [sequences[i] for i in order[at : at + batch]]
            lengths = np.array([len(w) for w, _ in some])
            flat = np.concatenate([w for w, _ in some])
            sizes = many[flat]
            word_of = np.repeat(np.arange(len(flat)), sizes)
            rows_of = row[np.repeat(begin[flat] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(word_of))]
            emit = np.stack([np.bincount(word_of, weights[rows_of, j], len(flat)) for j in range(k)], axis=1)
            padded = np.zeros((len(some), lengths.max(), k))
            live = np.arange(lengths.max())[None, :] < lengths[:, None]
            padded[live] = emit
            post, pairs = forward_backward(padded, moves, lengths)
            truth = np.repeat([y for _, y in some], lengths)
            error = -post[live]
            error[np.arange(len(truth)), truth] += 1
            gradient = np.stack([np.bincount(rows_of, error[word_of, j], size) for j in range(k)], axis=1) / len(some)
            touched = np.unique(rows_of)
            g = gradient[touched] - decay * weights[touched]
            squares[touched] += (g**2).sum(axis=1)
            weights[touched] += rate * g / np.sqrt(squares[touched])[:, None]
            seen = np.zeros_like(moves)
            np.add.at(seen, ([y for _, y in some],) * 2, lengths - 1)
            g = (seen - pairs) / len(some) / SEQUENCE - 1e-3 * moves
            move_squares += g**2
            moves += rate * g / np.sqrt(move_squares)
    return Model(languages, weights.astype(np.float32), moves.astype(np.float32), lexicon)


def train(docs: DataFrame, allowed: Column | None = None, max_docs: int = TRAIN_DOCS) -> Model:
    """Fit on a bounded sample: the `max_docs` labelled documents with the smallest hash of their id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    if allowed is not None:
        labelled = labelled.where(allowed)
    ranked = labelled.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_docs)
    last = ranked.agg(F.max("h")).first()[0]
    if last is None:
        return Model([], np.zeros((TABLE, 1), np.float32), np.zeros((1, 1), np.float32), {})
    chosen = labelled.where(F.xxhash64("doc_id") <= last).select(F.xxhash64("doc_id").alias("h"), "text", "lang").orderBy("h", "lang", "text").limit(max_docs).collect()
    return fit([(r["text"], r["lang"]) for r in chosen])


class Predictor:
    """Applies a model in a worker; remembers emissions by word."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.emissions = np.zeros((0, max(1, len(model.languages))), np.float32)
        self.lettered = np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        """Emissions of words that are new, all at once."""
        if len(self.rows) > CACHE:
            self.rows, self.emissions, self.lettered = {}, self.emissions[:0], self.lettered[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        bare = [core(w) for w in new]
        emit = np.zeros((len(new), self.emissions.shape[1]), np.float32)
        owner, rows = features(bare)
        if len(rows):
            values = self.model.weights[rows]
            for j in range(emit.shape[1]):
                emit[:, j] = np.bincount(owner, values[:, j], len(new))
        listed = [(i, self.model.lexicon[w]) for i, w in enumerate(bare) if w in self.model.lexicon]
        if listed:
            at, row = np.array(listed).T
            emit[at] += self.model.weights[row]
        at = len(self.rows)
        self.rows.update(zip(new, range(at, at + len(new))))
        self.emissions, self.lettered = np.concatenate([self.emissions, emit]), np.concatenate([self.lettered, np.array([bool(w) for w in bare], bool)])

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, the marginals of its lettered words."""
        words = [t.lower().split() for t in texts]
        self._learn([w for ws in words for w in ws])
        look = self.rows.__getitem__
        ids = [np.fromiter(map(look, ws), np.int64, len(ws)) for ws in words]
        parts = [(d, x[i : i + SEQUENCE]) for d, x in enumerate(ids) for i in range(0, len(x), SEQUENCE)]
        out: list[list] = [[] for _ in texts]
        if parts:
            lengths = np.array([len(x) for _, x in parts])
            live = np.arange(lengths.max())[None, :] < lengths[:, None]
            flat = np.concatenate([x for _, x in parts])
            emit = np.zeros((*live.shape, self.emissions.shape[1]), np.float32)
            emit[live] = self.emissions[flat]
            post, _ = forward_backward(emit, self.model.moves, lengths)
            word_post, kept = post[live], self.lettered[flat]
            at = 0
            for (d, x), n in zip(parts, lengths):
                out[d].append(word_post[at : at + n][kept[at : at + n]])
                at += n
        empty = np.zeros((0, self.emissions.shape[1]), np.float32)
        return [np.concatenate(x) if x else empty for x in out]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score; input columns of these names give way."""
    new = {"lang_pred": T.StringType(), "score": T.DoubleType()}
    carried = columns_beside(docs, new)
    at = carried.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size but for the lexicon, bounded by TRAIN_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.common import slices

        apply = Predictor(shared.value)
        names = apply.model.languages
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            pred, score = [], []
            for a, b in slices([len(t) for t in texts], 2_000_000):
                for t, m in zip(texts[a:b], apply.marginals(texts[a:b])):
                    total = m.sum(axis=0, dtype=np.float64)
                    if not names or not any(c.isalpha() for c in t) or total.sum() <= 0:
                        pred.append("und"), score.append(0.0)
                    else:
                        pred.append(names[int(total.argmax())]), score.append(float(min(1.0, total.max() / total.sum())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*carried, *new])

    fields = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(n, t) for n, t in new.items())])
    return docs.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(run, fields)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that must not be learned from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
