"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows, once from the left and
once from the right, and gives every position a probability for each language
from both states; the probabilities of all positions of a document are
averaged. It is trained here, in numpy, by backpropagation through time on
windows of a bounded sample of labelled documents. The same trained weights
then label all documents, each task working on its own rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import batches, checkpointed

# The bound of the training sample: so many documents of a language are
# expected, less where all languages together would have more than SAMPLE_ALL
# but one at least, and never more than about twice as many taken; so many
# windows of each. Every language is learned, however many there are.
SAMPLE_DOCS = 400
SAMPLE_ALL = 20_000
WINDOWS_A_DOC = 6
# Languages whose counts, some 50 bytes each, go to all tasks; more are joined by a shuffle.
FEW_LANGUAGES = 50_000

HIDDEN = 12
WINDOW = 128  # bytes; a longer text has more windows
EPOCHS = 3
BATCH = 128
RATE = 0.02
# Windows that run side by side, and characters of text that a task encodes at once.
LANES = 1024
RUN = 2 << 20

UNKNOWN = "und"
# The name of what is no language, beside those that are learned.
NOISE = "\0noise"
LETTER = regex.compile(r"\p{L}")


def _sigmoid_of_minus(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e^x), in place; numpy has a fast exponential, but no fast tanh."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """One gated recurrent layer: ``given`` has the gates' inputs of each byte
    value, ``carried`` turns the last state into the gates' other inputs."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.given = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.carried = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)

    def run(self, data: np.ndarray, live: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States after each byte, (steps, lanes, hidden). Where ``live`` is 0
        the state is 0. ``keep`` gathers what the way back needs."""
        steps, lanes = data.shape
        hidden = len(self.carried)
        # Each gate has arrays of its own, with the sign and factor of its exponential.
        factor = np.repeat(np.array([-1, -1, -2], np.float32), hidden)
        given = [np.ascontiguousarray(g) for g in np.split(self.given * factor, 3, axis=1)]
        carried = [np.ascontiguousarray(c) for c in np.split(self.carried * factor, 3, axis=1)]
        states = np.empty((steps, lanes, hidden), np.float32)
        state = np.zeros((lanes, hidden), np.float32)
        hold, let, new, from_new, read = (np.empty((lanes, hidden), np.float32) for _ in range(5))
        with np.errstate(over="ignore"):
            for t in range(steps):
                np.matmul(state, carried[0], out=hold)
                hold += np.take(given[0], data[t], axis=0, out=read, mode="clip")
                _sigmoid_of_minus(hold)
                np.matmul(state, carried[1], out=let)
                let += np.take(given[1], data[t], axis=0, out=read, mode="clip")
                _sigmoid_of_minus(let)
                np.matmul(state, carried[2], out=from_new)
                np.multiply(let, from_new, out=new)
                new += np.take(given[2], data[t], axis=0, out=read, mode="clip")
                _sigmoid_of_minus(new)
                new *= 2
                new -= 1
                if keep is not None:
                    keep.append((state, hold.copy(), let.copy(), new.copy(), from_new / -2))
                state = np.subtract(state, new, out=states[t])
                state *= hold
                state += new
                if live is not None:
                    state *= live[t][:, None]
        return states

    def back(self, data: np.ndarray, live: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of ``given`` and ``carried`` from those of the states."""
        steps, lanes = data.shape
        hidden = len(self.carried)
        d_inputs = np.empty((steps, lanes, 3 * hidden), np.float32)
        d_carried = np.zeros_like(self.carried)
        d_next = np.zeros((lanes, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            state, hold, let, new, from_new = kept[t]
            d = (d_states[t] + d_next) * live[t][:, None]
            d_new = d * (1 - hold) * (1 - new * new)
            d_hold = d * (state - new) * hold * (1 - hold)
            d_let = d_new * from_new * let * (1 - let)
            d_from = np.concatenate([d_hold, d_let, d_new * let], axis=1)
            d_inputs[t] = np.concatenate([d_hold, d_let, d_new], axis=1)
            d_carried += state.T @ d_from
            d_next = d * hold + d_from @ self.carried.T
        order = np.argsort(data, axis=None, kind="stable")
        values, first = np.unique(data.reshape(-1)[order], return_index=True)
        d_given = np.zeros_like(self.given)
        d_given[values] = np.add.reduceat(d_inputs.reshape(-1, 3 * hidden)[order], first)
        return [d_given, d_carried]


class Network:
    """Two directions and one softmax over languages at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.right, self.left = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.right.given, self.right.carried, self.left.given, self.left.carried, self.out, self.bias]

    def positions(self, data: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        """Probabilities of each language at each position, (steps, lanes, languages)."""
        hidden = len(self.right.carried)
        turned = None if live is None else live[::-1]
        logits = self.right.run(data, live) @ self.out[:hidden]
        logits += self.left.run(data[::-1], turned)[::-1] @ self.out[hidden:]
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, live: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all live positions."""
        hidden = len(self.right.carried)
        kept_right, kept_left = [], []
        right = self.right.run(data, live, kept_right)
        left = self.left.run(data[::-1], live[::-1], kept_left)[::-1]
        both = np.concatenate([right, left], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=2, keepdims=True)
        chance[:, np.arange(data.shape[1]), wanted] -= 1
        chance *= live[:, :, None] / live.sum()
        flat = chance.reshape(-1, chance.shape[2])
        d_out = both.reshape(-1, 2 * hidden).T @ flat
        d_both = chance @ self.out.T
        d_right = self.right.back(data, live, kept_right, d_both[:, :, :hidden])
        d_left = self.left.back(data[::-1], live[::-1], kept_left, d_both[::-1, :, hidden:])
        return [*d_right, *d_left, d_out, flat.sum(axis=0)]


def train(texts: list[bytes], langs: list[str], seed: int = 3, noise: bool = False) -> Network:
    """A network fitted to windows of labelled texts, by Adam. With ``noise`` it
    also learns `NOISE`, from windows whose bytes are put in a random order or
    drawn anew."""
    languages = sorted(set(langs))
    if noise:
        languages.append(NOISE)
    network = Network(languages, seed=seed)
    rng = np.random.default_rng(seed)
    windows, wanted = [], []
    for text, lang in zip(texts, langs, strict=True):
        for _ in range(min(WINDOWS_A_DOC, 1 + len(text) // WINDOW)):
            start = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
            windows.append(text[start : start + WINDOW])
            wanted.append(languages.index(lang))
    if noise:
        for k in rng.permutation(len(windows))[: max(1, len(windows) // (len(languages) - 1))].tolist():
            data = np.frombuffer(windows[k], np.uint8)
            drawn = rng.integers(32, 127, len(data)).astype(np.uint8)
            windows.append((rng.permutation(data) if rng.random() < 0.5 else drawn).tobytes())
            wanted.append(len(languages) - 1)
    wanted = np.array(wanted)
    # Every language counts the same, however many documents it has.
    share = np.bincount(wanted, minlength=len(languages))
    chance = (1 / share[wanted]) / (1 / share[wanted]).sum()
    first, second = ([np.zeros_like(w) for w in network.weights()] for _ in range(2))
    steps = max(1, EPOCHS * len(windows) // BATCH)
    for step in range(1, steps + 1):
        chosen = rng.choice(len(windows), BATCH, p=chance)
        data, live = lanes([windows[i] for i in chosen], WINDOW)
        grads = network.gradients(data, live, wanted[chosen])
        rate = RATE * min(1.0, 20 * (1.02 - step / steps)) * (1 - 0.9 * step / steps)
        for w, g, a, b in zip(network.weights(), grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return network


def lanes(pieces: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as columns of byte values, and 1 where there is a byte."""
    data = np.frombuffer(b"".join(p.ljust(steps, b"\0") for p in pieces), np.uint8).reshape(-1, steps).T
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.ascontiguousarray(data), (np.arange(steps)[:, None] < size).astype(np.float32)


class Labeller:
    """Pools the position probabilities of many texts."""

    def __init__(self, network: Network):
        self.network = network

    def positions(self, text: bytes) -> list[str]:
        """The language of every byte of a text."""
        pieces = [text[k : k + WINDOW] for k in range(0, len(text), WINDOW)]
        if not pieces:
            return []
        best = self.network.positions(*lanes(pieces, WINDOW)).argmax(axis=2).T.reshape(-1)[: len(text)]
        return [self.network.languages[k] for k in best]

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """The mean probability of each language over all bytes of each text."""
        total = np.zeros((len(texts), len(self.network.languages)))
        full, owners, short, short_owners = [], [], [], []
        for k, text in enumerate(texts):
            for start in range(0, len(text), WINDOW):
                piece = text[start : start + WINDOW]
                if len(piece) == WINDOW:
                    full.append(piece)
                    owners.append(k)
                else:
                    short.append(piece)
                    short_owners.append(k)
                if len(full) == LANES:
                    self._add(total, full, owners, WINDOW, False)
                    full, owners = [], []
        if full:
            self._add(total, full, owners, WINDOW, False)
        order = sorted(range(len(short)), key=lambda i: len(short[i]))
        for start in range(0, len(order), LANES):
            some = order[start : start + LANES]
            self._add(total, [short[i] for i in some], [short_owners[i] for i in some], len(short[some[-1]]), True)
        return total / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]

    def _add(self, total: np.ndarray, pieces: list[bytes], owners: list[int], steps: int, ragged: bool) -> None:
        data, live = lanes(pieces, steps)
        chance = self.network.positions(data, live if ragged else None)
        if ragged:
            chance *= live[:, :, None]
        np.add.at(total, owners, chance.sum(axis=0, dtype=np.float64))


def held_out(doc_id: Column) -> Column:
    """The third of all documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, noise: bool = False) -> Network | None:
    """The network trained on a bounded sample of the documents that have a
    text and a ``lang`` and are not held out; None if there are none."""
    usable = docs.where(
        F.col("text").isNotNull() & (F.col("text") != "") & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", "lang", "text")
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    counts = checkpointed(usable.groupBy("lang").agg(F.count("*").alias("in_all"), F.min(drawn).alias("first")))
    n_langs = counts.count()
    if not n_langs:
        return None
    sample_docs = max(1, min(sample_docs, SAMPLE_ALL // n_langs))
    wanted = (drawn < F.lit(float(sample_docs)) / F.col("in_all")) | (drawn == F.col("first"))
    # Of a long text a stretch at a drawn place leaves the executors; windows are drawn from it.
    size = F.lit(40 * WINDOW)
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.lit(1), F.char_length("text") - size)) + 1
    stretch = F.substring(F.col("text"), place, size)
    # A checkpoint has no known size, so its rows are counted here.
    counts = F.broadcast(counts) if n_langs <= FEW_LANGUAGES else counts
    rows = (
        usable.join(counts, "lang")
        .where(wanted)
        .limit(2 * (sample_docs + 1) * n_langs)
        .select("doc_id", "lang", stretch.cast("binary").alias("text"))
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], bytes(r[2])))
    return train([bytes(r[2]) for r in rows], [r[1] for r in rows], noise=noise) if rows else None


_LABELS = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def label_texts(network: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, mean probability) of each text; ``und`` without a letter or a network."""
    known = [k for k, t in enumerate(texts) if network and t and LETTER.search(t)]
    found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    while known:  # some megabytes of text at a time
        take, size = 0, 0
        while take < len(known) and size < RUN:
            size += len(texts[known[take]])
            take += 1
        some, known = known[:take], known[take:]
        for k, chances in zip(some, Labeller(network).pool([texts[k].encode() for k in some]), strict=True):
            best = int(chances.argmax())
            found[k] = network.languages[best], float(min(1.0, chances[best]))
    return found


def label_column(network: Network | None, texts: pa.Array) -> list[tuple[str, float]]:
    """`label_texts` for a column; only a run of it is held as Python text."""
    found, run, size = [], [], 0
    for k in range(len(texts)):
        run.append(texts[k].as_py())
        size += len(run[-1] or "")
        if size >= RUN or k + 1 == len(texts):
            found += label_texts(network, run)
            run, size = [], 0
    return found


def labelled(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    A text that is null, empty or has no letter is ``und`` with score 0. The
    prediction sees the text alone, the whole of it. Rows that repeat get the
    same label; a null ``doc_id`` is not held out. Other columns are not looked
    at, and an empty table gives an empty table.
    """
    network = network or learned(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *_LABELS])

    def label(parts):
        for part in parts:
            found = label_column(network, part.column(2))
            rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), *zip(*found, strict=True), strict=True)
            yield from batches(schema, rows)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return slim.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


# The length, in bytes, from which on the bound on noise falls quickly.
NOISE_BYTES = 768


def most_noise(size: np.ndarray) -> np.ndarray:
    """The mean probability of `NOISE` up to which a text of so many bytes
    stays. A short text says little, so only near certainty rejects it."""
    return 0.5 + 0.5 * (NOISE_BYTES / (NOISE_BYTES + size)) ** 0.5


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a language; the columns are those of ``docs``.

    A text without a letter goes, null and empty ones included. So does one
    that the network, trained here with noise beside the languages, takes for
    noise with a pooled probability above `most_noise` of its length. Where no
    document has a ``lang`` to learn from, only texts without a letter go.
    """
    network = learned(docs, noise=True)

    def fine(texts: pa.Array) -> pa.Array:
        return pa.array([kept for kept, _ in noise_column(network, texts)], pa.bool_())

    return docs.where(F.arrow_udf(fine, "boolean")("text"))


def noise_column(network: Network | None, texts: pa.Array) -> list[tuple[bool, float]]:
    """(stays, probability of noise) of each text of a column, in bounded runs."""
    found: list[tuple[bool, float]] = []
    run, size = [], 0
    for k in range(len(texts)):
        run.append(texts[k].as_py() or "")
        size += len(run[-1])
        if size < RUN and k + 1 < len(texts):
            continue
        lettered = [i for i, t in enumerate(run) if LETTER.search(t)]
        some = [(False, 0.0)] * len(run)
        if lettered:
            data = [run[i].encode() for i in lettered]
            noise = Labeller(network).pool(data)[:, network.languages.index(NOISE)] if network else np.zeros(len(data))
            stays = noise <= most_noise(np.fromiter(map(len, data), np.int64, len(data)))
            for i, keep, p in zip(lettered, stays.tolist(), noise.tolist(), strict=True):
                some[i] = keep, p
        found += some
        run, size = [], 0
    return found
