"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of
a word is the sum over all its segmentations into pieces of the product of their probabilities,
which a forward pass computes; a text's is the product over its words. Piece probabilities are
learned from the expected counts of a forward-backward pass in which all pieces weigh the same.

All passes run over many distinct words at once, position by position. Long words go in parts;
the state at the end of a part is carried to the next, so no segmentation is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, Memo, any_columns, as_bytes, quoted, slices, without

UND = "und"
#: Longer words are scored in parts of ``PART`` letters and rescaled every ``RESCALE`` letters.
WORD_CHARS = 24
PART = 256
RESCALE = 16
#: Letters that go through a pass together; a single longer word goes alone.
LOT_CHARS = 480_000
SMOOTHING = 0.5
#: Expected counts are summed as integers of this fraction, so that reruns agree.
FRACTION = 1 << 16
CACHED_WORDS = 250_000
COUNTED_WORDS = 400_000
#: Leading bits of piece hashes that are looked up before a search.
FIRST_BITS = 20
BASE = U64(0x9E3779B97F4A7C15)


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of letters and marks of a sentencepiece model, in lower case, without ``▁``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(len(model))}
    return sorted(p for p in found if p and all(c.isalpha() or category(c)[0] == "M" for c in p))


def only_letters(text: str) -> str:
    """Letters and combining marks of a text; nothing if there is no letter among them."""
    if text.isalpha():
        return text
    found = "".join(c for c in text if c.isalpha() or category(c)[0] == "M")
    return found if any(map(str.isalpha, found)) else ""


class Pieces:
    """The vocabulary as hashes of its pieces. The last id stands for any unknown letter."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.cumprod(np.append(U64(1), np.full(self.longest + 1, BASE)))
        h = np.zeros(len(pieces), U64)
        for k in range(self.longest):
            here = np.array([ord(p[k]) + 1 if k < len(p) else 0 for p in pieces], U64)
            h = np.where(here > 0, h * BASE + here, h)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        # Most substrings are no piece; their first bits tell so without a search.
        self.begun = np.zeros(1 << FIRST_BITS, bool)
        self.begun[h >> U64(64 - FIRST_BITS)] = True

    def _found(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(h.shape, -1, np.int32)
        if len(self.hashes):
            maybe = np.nonzero(self.begun[h >> U64(64 - FIRST_BITS)])
            looked = h[maybe]
            at = np.searchsorted(self.hashes, looked)
            at[at == len(self.hashes)] = 0
            out[maybe] = np.where(self.hashes[at] == looked, self.order[at], -1)
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and the id of each word's piece that ends at a position with a length.

        ``ids[end, n - 1, w]`` is -1 where that substring is no piece.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(U64) + U64(1)
        wide = int(lengths.max())
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid = np.zeros((wide, len(words)), U64)
        grid[place, word] = codes
        prefix = np.zeros((wide + 1, len(words)), U64)
        for i in range(wide):
            prefix[i + 1] = prefix[i] * BASE + grid[i]
        most = min(self.longest, wide)
        ids = np.full((wide + 1, most, len(words)), -1, np.int32)
        for n in range(1, most + 1):
            own = self._found(prefix[n:] - prefix[:-n] * self.powers[n])
            if n == 1:
                own[own < 0] = self.size - 1
            ids[n:, n - 1] = own
        beyond = np.arange(wide + 1)[:, None] > lengths[None, :]
        ids.transpose(0, 2, 1)[beyond] = -1
        return lengths, ids

    def log_likelihood(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations: words x languages."""
        if max(map(len, words)) > WORD_CHARS:
            return self._long_likelihood(words, probability)
        lengths, ids = self.lattice(words)
        alpha = np.zeros((ids.shape[0], len(words), probability.shape[1]))
        alpha[0] = 1
        for end in range(1, ids.shape[0]):
            for n in range(1, min(end, ids.shape[1]) + 1):
                k = np.flatnonzero(ids[end, n - 1] >= 0)
                alpha[end, k] += alpha[end - n, k] * probability[ids[end, n - 1, k]]
        return np.log(alpha[lengths, np.arange(len(words))])

    def expected_counts(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, summed over words with weights: pieces x columns."""
        if max(map(len, words)) > WORD_CHARS:
            return self._long_counts(words, weight)
        lengths, ids = self.lattice(words)
        p = 1.0 / self.size
        wide, most, n_words = ids.shape[0] - 1, ids.shape[1], len(words)
        used = {
            (end, n): np.flatnonzero(ids[end, n - 1] >= 0)
            for end in range(1, wide + 1)
            for n in range(1, min(end, most) + 1)
        }
        alpha = np.zeros((wide + 1, n_words))
        alpha[0] = 1
        for end in range(1, wide + 1):
            for n in range(1, min(end, most) + 1):
                k = used[end, n]
                alpha[end, k] += alpha[end - n, k] * p
        beta = np.zeros((wide + 1, n_words))
        beta[lengths, np.arange(n_words)] = 1
        for end in range(wide, 0, -1):
            for n in range(1, min(end, most) + 1):
                k = used[end, n]
                beta[end - n, k] += beta[end, k] * p
        total = alpha[lengths, np.arange(n_words)]
        out = np.zeros((self.size, weight.shape[1]))
        for n in range(1, most + 1):
            for end in range(n, wide + 1):
                k = used[end, n]
                if len(k):
                    share = alpha[end - n, k] * p * beta[end, k] / total[k]
                    piece = ids[end, n - 1, k]
                    for c in range(weight.shape[1]):
                        out[:, c] += np.bincount(piece, share * weight[k, c], self.size)
        return out

    def _parts(
        self, words: list[str], backward: bool = False
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``a, rows, ids`` for each part: ``ids[j, :, w]`` are pieces of ``rows[w]`` ending at a + j."""
        lengths = np.array([len(w) for w in words])
        firsts = range(0, int(lengths.max()), PART)
        for a in reversed(firsts) if backward else firsts:
            rows = np.flatnonzero(lengths > a)
            before = min(a, self.longest - 1)
            _, ids = self.lattice([words[i][a - before : a + PART] for i in rows])
            yield a, rows, ids[before:]

    def _forward(self, words: list[str], probability: np.ndarray) -> Iterator[tuple]:
        """``end, rows, state, log scale`` at every end of any word's piece."""
        table = np.vstack([probability, np.zeros((1, probability.shape[1]))])  # id -1
        most = self.longest
        shape = (len(words), probability.shape[1])
        tail, scale = np.zeros((most, *shape)), np.zeros(shape)
        tail[-1] = 1
        for a, rows, ids in self._parts(words):
            # alpha[most - 1 + j] belongs to position a + j.
            alpha = np.zeros((most + ids.shape[0] - 1, len(rows), shape[1]))
            alpha[:most] = tail[:, rows]
            for j in range(1, ids.shape[0]):
                now = alpha[most - 1 + j]
                for n in range(1, ids.shape[1] + 1):
                    now += alpha[most - 1 + j - n] * table[ids[j, n - 1]]
                yield a + j, rows, now, scale[rows]
                if j % RESCALE == 0:
                    recent = alpha[j : most + j]
                    top = recent.max(0)
                    top[top == 0] = 1
                    recent /= top
                    scale[rows] += np.log(top)
            tail[:, rows] = alpha[-most:]

    def _long_likelihood(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        lengths = np.array([len(w) for w in words])
        out = np.zeros((len(words), probability.shape[1]))
        for end, rows, state, scale in self._forward(words, probability):
            done = np.flatnonzero(lengths[rows] == end)
            if len(done):
                out[rows[done]] = np.log(state[done]) + scale[done]
        return out

    def _long_counts(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        lengths = np.array([len(w) for w in words])
        p, most = 1.0 / self.size, self.longest
        logs = np.full((int(lengths.max()) + 1, len(words)), -np.inf)
        logs[0] = 0
        with np.errstate(divide="ignore"):
            for end, rows, state, scale in self._forward(words, np.full((self.size, 1), p)):
                logs[end, rows] = np.log(state[:, 0]) + scale[:, 0]
        total = logs[lengths, np.arange(len(words))]
        out = np.zeros((self.size, weight.shape[1]))
        head, scale = np.zeros((most, len(words))), np.zeros(len(words))
        for a, rows, ids in self._parts(words, backward=True):
            # beta[most - 1 + j] belongs to position a + j; the last ones come from the next part.
            beta = np.zeros((most + ids.shape[0] - 1, len(rows)))
            beta[-most:] = head[:, rows]
            closing = lengths[rows] < a + ids.shape[0]
            beta[most - 1 + lengths[rows[closing]] - a, np.flatnonzero(closing)] = 1
            for j in range(ids.shape[0] - 1, 0, -1):
                if j % RESCALE == 0:
                    recent = beta[j : most + j]
                    top = recent.max(0)
                    top[top == 0] = 1
                    recent /= top
                    scale[rows] += np.log(top)
                now = beta[most - 1 + j]
                with np.errstate(divide="ignore"):
                    after = np.log(now) + scale[rows] + np.log(p) - total[rows]
                for n in range(1, ids.shape[1] + 1):
                    k = np.flatnonzero(ids[j, n - 1] >= 0)
                    if len(k):
                        share = np.exp(logs[a + j - n, rows[k]] + after[k])
                        np.add.at(out, ids[j, n - 1, k], share[:, None] * weight[rows[k]])
                        beta[most - 1 + j - n, k] += now[k] * p
            head[:, rows] = beta[:most]
        return out


def letters(word: bytes) -> str:
    """A word's letters and combining marks in lower case; nothing if it has no letter."""
    return only_letters(word.decode().lower())


def in_lots(items: list, lot: int = 20_000) -> Iterator[list]:
    """Items by length, so that a lot is a narrow array; long ones are fewer and by themselves."""
    items = sorted(items, key=len)
    first = 0
    while first < len(items):
        last = first + 1
        long = len(items[first]) > WORD_CHARS
        while (
            last < min(len(items), first + lot)
            and (len(items[last]) > WORD_CHARS) == long
            and (last + 1 - first) * len(items[last]) <= LOT_CHARS
        ):
            last += 1
        yield items[first:last]
        first = last


def train(
    docs: DataFrame,
    pieces: list[str],
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from all rows with a text and a language.

    Every word of every text counts. What reaches the driver is one number for each piece and
    language, whatever the number of rows.
    """
    source = docs.where(quoted(lang_col).isNotNull() & quoted(text_col).isNotNull()).select(
        quoted(lang_col).alias("lang"), quoted(text_col).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(pieces)
        counts: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def flush() -> None:
            langs = list(counts)
            parts: dict[str, np.ndarray] = {}
            for i, lang in enumerate(langs):
                for word, n in counts[lang].items():
                    if part := letters(word):
                        parts.setdefault(part, np.zeros(len(langs)))[i] += n
            for lot in in_lots(list(parts)):
                weight = np.array([parts[w] for w in lot])
                got = vocabulary.expected_counts(lot, weight)
                for i, lang in enumerate(langs):
                    sums[lang] = sums.get(lang, 0) + got[:, i]
            counts.clear()

        for batch in batches:
            for part in slices(batch, 1):
                langs = part.column(0).to_pylist()
                for lang, text in zip(langs, as_bytes(part.column(1)), strict=True):
                    counts.setdefault(lang, Counter()).update(text.lower().split())
                if sum(map(len, counts.values())) > COUNTED_WORDS:
                    flush()
        flush()
        for lang, total in sums.items():
            whole = np.rint(total * FRACTION).astype(np.int64)
            used = np.flatnonzero(whole)
            yield pa.record_batch(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(whole[used])],
                names=["lang", "piece", "n"],
            )

    counted = (
        source.mapInArrow(run, "lang string, piece bigint, n bigint")
        .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = sorted(set(counted["lang"].to_pylist()), key=str.encode)
    size = len(pieces) + 1
    table = np.full((size, max(1, len(langs))), SMOOTHING)
    at = np.array([langs.index(x) for x in counted["lang"].to_pylist()], np.int64)
    table[counted["piece"].to_numpy(), at] += counted["n"].to_numpy() / FRACTION
    return langs, table / table.sum(0)



@any_columns
def predict(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray],
    pieces: list[str],
    text_col: str = "text",
) -> DataFrame:
    """Add ``lang_pred``, ``score``, the probability of that language given the whole text, and
    ``has_letters``, which tells texts without any letter from those without a learned language.

    All languages have the same prior; ties go to the first by code point. Texts that are null or
    have no letter, and all texts if no language was learned, get ``und`` and score 0. Input
    columns of the three names are replaced; an empty table gives an empty table.
    """
    docs = without(docs, "lang_pred", "score", "has_letters")
    langs = model[0]
    names = docs.columns
    text_at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(pieces)
        memo = Memo(CACHED_WORDS)
        for batch in batches:
            for part in slices(batch, text_at):
                best, score, lettered = _scored(
                    as_bytes(part.column(text_at)), vocabulary, shared.value, memo, len(langs)
                )
                yield pa.record_batch(
                    [
                        *part.columns,
                        pa.array([UND if b < 0 else langs[b] for b in best], pa.string()),
                        pa.array(score),
                        pa.array(lettered),
                    ],
                    names=[*names, "lang_pred", "score", "has_letters"],
                )

    schema = ", ".join(
        f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema
    )
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, has_letters boolean")


def _scored(
    texts: list[bytes | None], vocabulary: Pieces, probability: np.ndarray, memo: Memo, n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = [(t or b"").lower().split() for t in texts]
    memo.retire()
    absent = memo.absent(set().union(*words))
    parts = {w: letters(w) for w in absent}
    known: dict[str, bytes] = {}
    for lot in in_lots(list(set(filter(None, parts.values())))):
        rows = vocabulary.log_likelihood(lot, probability)
        known.update(zip(lot, map(bytes, rows), strict=True))
    nothing = np.zeros(probability.shape[1] + 1)
    for w, own in parts.items():
        row = nothing
        if own:
            row = np.append(np.frombuffer(known[own]), 1.0)
        memo[w] = row.tobytes()
    best = np.full(len(texts), -1, np.int64)
    score = np.zeros(len(texts))
    lettered = np.zeros(len(texts), bool)
    get = memo.__getitem__
    for i, own in enumerate(words):
        total = np.frombuffer(b"".join(map(get, own))).reshape(-1, len(nothing)).sum(0)
        lettered[i] = total[-1] > 0
        if n and lettered[i]:
            logs = total[:n]
            best[i] = int(np.argmax(logs))
            score[i] = 1.0 / np.exp(logs - logs.max()).sum()
    return best, score, lettered


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row belongs to the held-out fold of its id; false without id."""
    crc = F.crc32(quoted(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))


@any_columns
def identify(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Learn from the rows of ``docs`` outside the held-out fold and predict all rows.

    Adds ``held_out``, ``lang_pred``, ``score`` and ``has_letters``; ``vocabulary`` is a sentencepiece model file.
    Language, source and id are not inputs of a prediction. See :func:`predict` for null texts.
    """
    docs = without(docs, "held_out", "lang_pred", "score", "has_letters")
    pieces = vocabulary_pieces(vocabulary)
    learned = train(docs.where(~held_out(id_col)), pieces, text_col, lang_col)
    return predict(docs.withColumn("held_out", held_out(id_col)), learned, pieces, text_col)
