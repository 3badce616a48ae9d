"""The best of a bounded list of products for each offer, found under bounds instead of by scoring every pair.

A task holds the list as arrays. For an offer it bounds the score of all its products at once: identifiers, brands and variant tokens
count exactly; of a name's similarity the parts that hang on shared words alone are exact, and a common subsequence has at most
the letters that both names have. Products are then scored exactly from the highest bound down, until no bound reaches the
best score so far. Where bounds part little, as with names of random letters, the names without a shared word are compared many at a
time: the rows of the common subsequence are numbers of 64 bits, one for each product.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from offerloom.functions.similarity import token_set

#: Weights of name, brand and packaging, what variants without common token cost, scores that identifiers give.
NAME, BRAND, PACK, APART, UNKNOWN = 0.58, 0.24, 0.18, 0.28, 0.5
SAME_EAN, OTHER_EAN, SAME_REF, SAME_REF_OTHER_BRAND, OTHER_REF = 1.0, 0.0, 0.99, 0.82, 0.08
REASONS = ("names", "other variant", "same EAN", "other EAN", "same reference", "same reference, other brand", "other reference")
#: Letters are counted in so many boxes; letters that share one make a bound looser, never wrong.
_BOXES = 64
_SLACK = 1e-9
#: Products that are scored one by one before others are compared together; how many together first, and from then on.
_SINGLY, _FEW, _AT_ONCE = 4, 64, 1024
#: Letters of a name whose common subsequences fit into one number.
_WORD = 64


def _letters(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.dtype("<u4")) % _BOXES, minlength=_BOXES)


class Names:
    """Folded names that others are compared with: bounds for all of them, the similarity of one."""

    def __init__(self, names: list[str]):
        self.names = names
        tokens = [sorted(set(n.split())) for n in names]
        self.n_tokens = np.array([len(t) for t in tokens], np.int64)
        self.lengths = np.array([len(" ".join(t)) for t in tokens], np.int64)
        self.letters = np.array([_letters(" ".join(t)) for t in tokens], np.int16).reshape(-1, _BOXES)
        places = defaultdict(list)
        for i, found in enumerate(tokens):
            for token in found:
                places[token].append(i)
        self.places = {token: np.array(p, np.int64) for token, p in places.items()}

        codes = sorted(set("".join(" ".join(t) for t in tokens)))
        self.code = {c: i + 1 for i, c in enumerate(codes)}
        #: The letters of each name's sorted words by number, 0 behind its end; a column for each name.
        self.spelt = np.zeros((int(self.lengths.max(initial=0)), len(names)), np.int32)
        for i, t in enumerate(tokens):
            joined = " ".join(t)
            self.spelt[: len(joined), i] = [self.code[c] for c in joined]

    def shared(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """For all names the number of words shared with one, and what ``token_set`` is at least; it is 1 where one set of words holds the other."""
        tokens = sorted(set(name.split()))
        shared, both = np.zeros(len(self.names), np.int64), np.zeros(len(self.names), np.int64)
        for token in tokens:
            if token in self.places:
                shared[self.places[token]] += 1
                both[self.places[token]] += len(token) + 1
        both -= shared > 0
        least = np.where(shared > 0, 2 * both / np.maximum(both + np.minimum(len(" ".join(tokens)), self.lengths), 1), 0.0)
        least[(shared > 0) & ((shared == len(tokens)) | (shared == self.n_tokens))] = 1.0
        return shared, least

    def most(self, name: str, least: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """What ``token_set`` is at most, for some names or all; exact where one set of words holds the other or either is empty."""
        rows = np.arange(len(self.names)) if rows is None else rows
        least = self.shared(name)[1] if least is None else least
        joined = " ".join(sorted(set(name.split())))
        if not joined:
            return np.zeros(len(rows))
        common = np.minimum(self.letters[rows], _letters(joined).astype(np.int16)).sum(axis=1, dtype=np.int64)
        out = np.minimum(2 * common / (len(joined) + np.maximum(self.lengths[rows], 1)), 1.0)
        out = np.maximum(out, least[rows])
        out[self.n_tokens[rows] == 0] = 0.0
        return out

    def apart(self, name: str, rows: np.ndarray) -> np.ndarray:
        """``token_set`` for names that share no word with one of at most 64 letters."""
        joined = " ".join(sorted(set(name.split())))
        hits = np.zeros(len(self.code) + 1, np.uint64)
        for i, c in enumerate(joined):
            if c in self.code:
                hits[self.code[c]] |= np.uint64(1 << i)
        row = np.full(len(rows), (1 << len(joined)) - 1, np.uint64)
        for letters in self.spelt[: int(self.lengths[rows].max(initial=0)), rows]:
            hit = row & hits[letters]
            row = (row + hit) | (row - hit)
        # bits above the name's are carries
        common = len(joined) - np.bitwise_count(row & np.uint64((1 << len(joined)) - 1)).astype(np.int64)
        return 2 * common / (len(joined) + self.lengths[rows])


class Shortlist:
    """Products by their features, each with its id; ``products`` are dicts of product_id, ean, ref, brand, name, pack, variants."""

    def __init__(self, products: list[dict]):
        self.ids = np.array([p["product_id"] for p in products], np.int64)
        #: Identifiers and brands as numbers, 0 for none.
        self.known = {c: {v: i for i, v in enumerate(dict.fromkeys(["", *(p[c] or "" for p in products)]))} for c in ("ean", "ref", "brand")}
        self.ean, self.ref, self.brand = (np.array([self.known[c][p[c] or ""] for p in products], np.int64) for c in ("ean", "ref", "brand"))
        self.name = Names([p["name"] or "" for p in products])
        packs = [p["pack"] or "" for p in products]
        self.packs = Names(sorted(set(packs)))
        where = {p: i for i, p in enumerate(self.packs.names)}
        self.pack = np.array([where[p] for p in packs], np.int64)
        self.no_pack = np.array([not p for p in packs], bool)
        self.varied = np.array([bool(p["variants"]) for p in products], bool)
        places = defaultdict(list)
        for i, p in enumerate(products):
            for v in p["variants"] or ():
                places[v].append(i)
        self.variants = {v: np.array(p, np.int64) for v, p in places.items()}

    def best(self, offer: dict, least: float | None = None) -> tuple[int | None, float | None, str | None, int]:
        """Id, score and reason of the best product, the newest of equals, and how many similarities were worked out; with ``least`` none below that score."""
        if not len(self.ids):
            return None, None, None, 0
        ean, ref, brand = (self.known[c].get(offer[c] or "", -1) for c in ("ean", "ref", "brand"))
        known = (self.brand != 0) & (brand != 0)
        same_brand = known & (self.brand == brand)
        score, reason = np.full(len(self.ids), np.nan), np.zeros(len(self.ids), np.int8)
        if ref:
            both = self.ref != 0
            same, conflict = both & (self.ref == ref), known & ~same_brand
            for mask, value, why in ((both & ~same, OTHER_REF, 6), (same & ~conflict, SAME_REF, 4), (same & conflict, SAME_REF_OTHER_BRAND, 5)):
                score[mask], reason[mask] = value, why
        if ean:
            both = self.ean != 0
            same = both & (self.ean == ean)
            for mask, value, why in ((both & ~same, OTHER_EAN, 3), (same, SAME_EAN, 2)):
                score[mask], reason[mask] = value, why
        best, at = (-1.0 if least is None else least, -np.inf), -1
        decided = np.flatnonzero(~np.isnan(score))
        if len(decided):
            top = decided[np.lexsort((self.ids[decided], score[decided]))[-1]]
            if (float(score[top]), int(self.ids[top])) > best:
                best, at = (float(score[top]), int(self.ids[top])), int(top)
        apart = np.zeros(len(self.ids), bool)
        if offer["variants"]:
            apart = self.varied.copy()
            for v in offer["variants"]:
                if v in self.variants:
                    apart[self.variants[v]] = False
        branded = np.where(known, same_brand, UNKNOWN).astype(float)
        pack = offer["pack"] or ""
        if pack:
            packed = np.where(self.no_pack, UNKNOWN, self.packs.most(pack)[self.pack])
        else:
            packed = np.full(len(self.ids), UNKNOWN)
        name = offer["name"] or ""
        least_cost = np.where(apart, APART, 0.0)
        bounded = lambda names, rows: np.clip(NAME * names + BRAND * branded[rows] + PACK * packed[rows] - least_cost[rows], 0.0, 1.0) + _SLACK
        exact_packs, n_scored = {}, 0

        def values(rows: np.ndarray, names: np.ndarray) -> np.ndarray:
            packs = np.full(len(rows), UNKNOWN)
            if pack:
                for n, i in enumerate(rows.tolist()):
                    if not self.no_pack[i]:
                        if self.pack[i] not in exact_packs:
                            exact_packs[self.pack[i]] = token_set(pack, self.packs.names[self.pack[i]])
                        packs[n] = exact_packs[self.pack[i]]
            return np.clip(NAME * names + BRAND * branded[rows] + PACK * packs - least_cost[rows], 0.0, 1.0)

        def score_all(rows: np.ndarray) -> None:
            nonlocal best, at, n_scored
            names = np.zeros(len(rows))
            whole = shared[rows] == 0 if len(rows) > 1 and len(" ".join(sorted(set(name.split())))) <= _WORD and name.split() else np.zeros(len(rows), bool)
            names[whole] = np.where(self.name.n_tokens[rows[whole]] > 0, self.name.apart(name, rows[whole]), 0.0) if whole.any() else 0.0
            for n in np.flatnonzero(~whole).tolist():
                names[n] = token_set(name, self.name.names[rows[n]]) if name and self.name.names[rows[n]] else 0.0
            found = values(rows, names)
            top = np.lexsort((self.ids[rows], found))[-1]
            n_scored += len(rows)
            if (float(found[top]), int(self.ids[rows[top]])) > best:
                best, at = (float(found[top]), int(self.ids[rows[top]])), int(rows[top])

        open_ = np.flatnonzero(np.isnan(score))
        if least is not None:
            open_ = open_[bounded(np.ones(len(open_)), open_) >= least]
            if not len(open_):
                return (best[1], best[0], REASONS[reason[at]], 0) if at >= 0 else (None, None, None, 0)
        shared, surely = self.name.shared(name)
        # one with the most shared words first: its score leaves few products whose names must be looked at
        first = bounded(surely[open_], open_)
        if len(open_) and first.max() >= best[0]:
            seed = open_[np.argmax(first)]
            if bounded(np.ones(1), np.array([seed]))[0] >= best[0]:
                score_all(np.array([seed]))
            open_ = open_[open_ != seed]
        open_ = open_[bounded(np.ones(len(open_)), open_) >= best[0]]
        bound = bounded(self.name.most(name, surely, open_), open_)
        order = np.lexsort((-self.ids[open_], -bound))
        open_, bound = open_[order], bound[order]
        place = 0
        while place < len(open_) and bound[place] >= best[0]:
            n = 1 if place < _SINGLY else _FEW if place == _SINGLY else _AT_ONCE
            some = slice(place, place + n)
            score_all(open_[some][bound[some] >= best[0]])
            place += n
        if at < 0:
            return None, None, None, n_scored
        why = REASONS[reason[at]] if reason[at] else REASONS[int(apart[at])]
        return best[1], best[0], why, n_scored


def best_in(block: tuple, offers: pa.Table, products: pa.Table, least: float) -> pa.Table:
    """For ``cogroup``: of the offers' rows the place and the best of the block's products, if it reaches ``least``: place, product_id, score, reason."""
    known, asked = Shortlist(products.to_pylist()), offers.to_pylist()
    found = [(o["place"], *known.best(o, least)[:3]) for o in asked]
    columns = list(zip(*(f for f in found if f[1] is not None))) or [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.string()))], names=["place", "product_id", "score", "reason"])


def best_of(products: list[dict]):
    """For ``mapInArrow``: a column ``a`` of features to a, product_id, score, reason, n_scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shortlist(products)
        for batch in batches:
            found = [known.best(offer) for offer in batch.column("a").to_pylist()]
            columns = list(zip(*found)) or [[], [], [], []]
            types = (pa.int64(), pa.float64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["a", "product_id", "score", "reason", "n_scored"])

    return run
