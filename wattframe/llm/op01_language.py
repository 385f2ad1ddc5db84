"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are taken in lower case, everything else is one space; runs of one to three characters fall into ``SLOTS``
slots by hash. The counts of a sample of labelled rows give a matrix of log probabilities, a row for each slot and a
column for each language, which goes to the workers (``SLOTS`` x languages x 4 bytes). A batch of texts is scored as a
sparse product: rows of the matrix are gathered for all n-grams of the batch and summed by document.

The sample has about ``TRAIN_ROWS`` rows a language at most, chosen by a hash of ``doc_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.texts import mix, slabs, tidy

SLOTS = 1 << 15
#: The bound of the sample of labelled rows, for each language, on which the model is fitted.
TRAIN_ROWS = 3_000
_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Every code point's letter in lower case, or a space."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, slot)`` of every n-gram of a slab, documents ascending, and each document's number of letters."""
    n_docs = len(offs) - 1
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    if heads[-1] != len(chars):  # not valid UTF-8: one document at a time
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:])]
        chars, heads = np.concatenate(parts) if parts else chars, np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    x = _table()[chars]
    doc = np.repeat(np.arange(n_docs), np.diff(heads))
    letters = np.bincount(doc, x != 32, n_docs)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = x[keep].astype(np.uint64), doc[keep]
    mask = np.uint64(SLOTS - 1)
    one = x * np.uint64(0x9E3779B97F4A7C15)
    slots, docs = [mix(one) & mask], [doc]
    for n in (2, 3):
        if len(x) >= n:
            one = (one[:-1] ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) + x[n - 1 :]
            ok = doc[n - 1 :] == doc[: len(doc) - n + 1]
            slots.append((mix(one) & mask)[ok])
            docs.append(doc[n - 1 :][ok])
    return np.concatenate(docs), np.concatenate(slots).astype(np.int64), letters


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(languages, log probabilities, log priors)`` from the rows outside the held-out fold with a text and a language."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((SLOTS, 0), np.float32), np.zeros(0)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, TRAIN_ROWS / sizes[k]) * (1 << 30))))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offs in slabs(batch.column(1), 1 << 18):
                doc, slot, _ = grams(data, offs)
                own = lang[lo:hi]
                for k in set(own):
                    total[k] = total.get(k, 0) + np.bincount(slot[own[doc] == k], minlength=SLOTS)
        for k, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "slot", "n"])

    found = sample.select("lang", "text").repartition(6).mapInArrow(tidy(count), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((SLOTS, len(langs)), 0.1)
    counts[found.slot.to_numpy(int), np.searchsorted(np.array(langs), found.lang.to_numpy(str))] += found.n.to_numpy(float)
    n = np.array([sizes[k] for k in langs], float)
    return langs, np.log(counts / counts.sum(0)).astype(np.float32), np.log(n / n.sum())


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``.

    ``score`` is the posterior probability of ``lang_pred``. A text that is null or has no letter is ``und`` with score
    0; so is every text if no row has a language to learn from. Ties go to the first language in order. A row with a
    null ``doc_id`` is not held out and not learnt from; rows that repeat are predicted alike. Other columns are not read.
    """
    langs, logs, prior = train(docs)
    names = np.array([*langs, "und"], object)

    def predict(batches):
        for batch in batches:
            for lo, hi, data, offs in slabs(batch.column(2), 1 << 18):
                doc, slot, letters = grams(data, offs)
                total = np.tile(prior, (hi - lo, 1))
                for j in range(len(langs)):
                    total[:, j] += np.bincount(doc, logs[:, j][slot], hi - lo)
                pick, score = np.full(hi - lo, len(langs)), np.zeros(hi - lo)
                if langs:
                    some = letters > 0
                    p = np.exp(total - total.max(1, keepdims=True))
                    pick[some], score[some] = total.argmax(1)[some], (p.max(1) / p.sum(1))[some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names[pick].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")
