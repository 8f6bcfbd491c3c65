r"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

A template with ``m`` shingles of five words belongs to the class of the next power of two ``L``. A document is covered by
windows of ``2 L`` shingles, one every ``L``, so every stretch of ``L`` lies whole in some window; a window that holds at
least ``LEAST`` of a template's shingles has a known least resemblance to it. Bands are single MinHash values, and a class
takes as many as make the chance that none agrees smaller than ``MISS``. A window and a template that share a band are
compared word for word around the window, and reported if the share of the template's shingles found in one stretch of the
text (``reach_of``) is ``LEAST`` or more.
A template that stands in a document several times is reported at each place.

Templates are a bounded parameter: ``license_texts`` by default, or any mapping of names to texts, such as ``read_templates``
makes of a folder of license files. Documents are read whole, in one pass, without a shuffle.

Defined cases: null and empty texts have no finding; a text shorter than a shingle has none; repeated rows each get their
findings; a null id is reported as null; an empty table gives no rows. Words are compared in ASCII lower case without the
marks around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.license_texts import TEMPLATES

SHINGLE = 5
LEAST = 0.8
MISS = 0.001
_MARKS = b".,;:!?\"'()[]{}<>*#|%$&"
_BATCH_WORDS = 200_000

def words_of(text: bytes | None) -> list[bytes]:
    return [w.strip(_MARKS) for w in (text or b"").lower().split()]


def shingles_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}


def _hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of the shingle that begins at each word but the last four."""
    digest = xxhash.xxh64_intdigest
    one = np.fromiter(map(digest, words), np.uint64, len(words))
    out = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + one[k : k + len(out)]
    return out


def _permuted(hashes: np.ndarray, nth: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(0xD6E8FEB86659FD93 * (nth + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    return mixed ^ (mixed >> np.uint64(29))


def reach_of(shingles: int) -> int:
    """Over how many places an occurrence of a template's shingles may stretch: half as far again as the template."""
    return shingles * 3 // 2 + SHINGLE


class TemplateIndex:
    """Bands of all templates by class."""

    def __init__(self, templates: dict[str, str], least: float = LEAST, miss: float = MISS):
        self.names = sorted(templates)
        self.shingles, self.classes, self.least = [], {}, least
        members: dict[int, list[int]] = {}
        hashed = []
        for nth, name in enumerate(self.names):
            words = words_of(templates[name].encode())
            shingles = shingles_of(words)
            if not shingles:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.shingles.append(shingles)
            hashed.append(np.unique(_hashes(words)))
            members.setdefault(1 << (len(shingles) - 1).bit_length(), []).append(nth)
        for size, nths in members.items():
            alike = min(math.ceil(least * len(self.shingles[n])) / (2 * size + len(self.shingles[n]) - math.ceil(least * len(self.shingles[n]))) for n in nths)
            bands = math.ceil(math.log(miss) / math.log(1 - alike))
            tables = []
            for band in range(bands):
                values = np.array([_permuted(hashed[n], band).min() for n in nths], np.uint64)
                order = np.argsort(values, kind="stable")
                tables.append((values[order], np.array(nths)[order]))
            self.classes[size] = tables

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(first shingle, size, template)`` of windows that share a band with a template."""
        for size, tables in self.classes.items():
            begins = np.arange(0, len(hashes), size)
            seen: set[tuple[int, int]] = set()
            for band, (values, owners) in enumerate(tables):
                block = np.minimum.reduceat(_permuted(hashes, band), begins)
                window = np.minimum(block, np.append(block[1:], np.uint64(0xFFFFFFFFFFFFFFFF)))
                at = np.searchsorted(values, window)
                for w in np.flatnonzero(values[np.minimum(at, len(values) - 1)] == window):
                    for k in range(at[w], len(values)):
                        if values[k] != window[w]:
                            break
                        seen.add((int(begins[w]), int(owners[k])))
            for begin, owner in seen:
                yield begin, size, owner

    def findings(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, float, int]]:
        """``(text number, template, containment, first word)`` of each occurrence."""
        split = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in split])
        flat = [w for words in split for w in words]
        hashes = _hashes(flat)
        if not len(hashes):
            return
        found_at: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for begin, size, owner in self.candidates(hashes):
            low, high = max(0, begin - size), begin + 3 * size + SHINGLE
            doc = int(np.searchsorted(ends, low, side="right"))
            while doc < len(split) and (int(ends[doc - 1]) if doc else 0) < high:
                first = int(ends[doc - 1]) if doc else 0
                a = max(low, first) - first
                part = split[doc][a : high - first]
                wanted = self.shingles[owner]
                held = [(k, s) for k in range(len(part) - SHINGLE + 1) if (s := tuple(part[k : k + SHINGLE])) in wanted]
                if len({s for _, s in held}) >= self.least * len(wanted):
                    place, share = self._place(held, wanted, begin - first - a)
                    if share >= self.least:
                        found_at.setdefault((doc, owner), []).append((a + place, share))
                doc += 1
        for (doc, owner), places in sorted(found_at.items()):
            reach, last = len(self.shingles[owner]) + SHINGLE - 1, None
            for place, share in sorted(places, key=lambda x: (x[0], -x[1])):
                if last is not None and place < last[0] + reach:  # the same occurrence, seen from another window
                    last = (last[0], max(last[1], share))
                    continue
                if last is not None:
                    yield doc, owner, last[1], last[0]
                last = (place, share)
            yield doc, owner, last[1], last[0]

    def _place(self, held: list[tuple[int, tuple]], wanted: set, near: int) -> tuple[int, float]:
        """Where the occurrence nearest to ``near`` begins, and the share of the template's shingles in reach of it.

        ``held`` are the matching shingles with their places.
        """
        reach, end = reach_of(len(wanted)), 0
        inside: dict[tuple, int] = {}
        full: list[tuple[int, float]] = []
        for at, shingle in held:
            while end < len(held) and held[end][0] < at + reach:
                inside[held[end][1]] = inside.get(held[end][1], 0) + 1
                end += 1
            if len(inside) >= self.least * len(wanted):
                full.append((at, len(inside) / len(wanted)))
            inside[shingle] -= 1
            if not inside[shingle]:
                del inside[shingle]
        if not full:
            return 0, 0.0
        nearest = min(full, key=lambda x: abs(x[0] - near))[0]
        where = {at: k for k, (at, _) in enumerate(held)}

        def stretch(at: int, share: float) -> int:
            """How many places on from ``at`` hold what its reach holds."""
            seen: set[tuple] = set()
            for place, shingle in held[where[at] :]:
                seen.add(shingle)
                if len(seen) >= share * len(wanted) - 1e-9:
                    return place - at
            return reach

        close = [(share, -stretch(at, share), -abs(at - nearest), -at) for at, share in full if abs(at - nearest) < reach]
        share, _, _, at = max(close)
        return -at, share


def read_templates(folder: str) -> dict[str, str]:
    """Templates from a folder of license texts on the driver: a name for each ``.txt`` file. They travel to the tasks."""
    return {path.stem: path.read_text(encoding="utf-8") for path in sorted(Path(folder).glob("*.txt"))}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license, containment, first_word``: a row for each place at which a document holds a template."""
    known = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(known)
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        size = 0

        def settle() -> pa.RecordBatch:
            rows = [(ids[d], index.names[t], share, place) for d, t, share, place in index.findings(texts)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "license", "containment", "first_word"])

        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or b"") // 6
                if size >= _BATCH_WORDS:
                    yield settle()
                    ids, texts, size = [], [], 0
        yield settle()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, license string, containment double, first_word long")
