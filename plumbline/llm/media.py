"""Copies of images by local descriptors.

Corners are found at several scales; around each, 256 comparisons of a fixed
pattern, turned to the patch's own orientation, make a binary descriptor.
Descriptors are cut in bands, and queries also ask for every band with one bit
turned: two descriptors that differ in fewer bits than twice the bands differ
in at most one bit of some band, so that equal band values (Hamming tables)
find every such pair. Queries travel in blocks of bounded size to where the
other descriptors are; descriptors match within the radius, each match proposes
a similarity transform, and a copy is what enough matches agree on.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import Scratch

SCALES = (1.0, 0.7, 0.5)
CORNERS = 64  # strongest corners of an image at each scale
BANDS = 8  # of 32 bits
RADIUS = 2 * BANDS - 1  # bits in which matching descriptors differ at most
SEEN = 200_000  # distinct images whose copies a task recognises at once
BLOCK = 40_000  # query descriptors that are sought at once
CANDIDATES = 1 << 17  # pairs that a task holds at once: they stay in a core's cache
PROBED = 20_000  # pairs of query descriptors that tell which bits to hold apart
REACH = 10  # pixels of a patch around its corner
_PATTERN = np.clip(np.random.RandomState(7).normal(0, REACH / 2.5, (256, 2, 2)), -REACH, REACH)
_DISC = np.array([(x, y) for x in range(-8, 9) for y in range(-8, 9) if x * x + y * y <= 64])
#: What a probe turns in a band: nothing, or one bit.
_TURNED = np.r_[0, 1 << np.arange(32)].astype(np.uint32)
_PNM = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM image; None if it is none."""
    m = _PNM.match(data or b"")
    if not m or int(m[4]) > 255:
        return None
    kind, w, h = int(m[1]), int(m[2]), int(m[3])
    depth = 3 if kind == 6 else 1
    body = np.frombuffer(data, dtype=np.uint8, offset=m.end())
    if not w or not h or len(body) < w * h * depth:
        return None
    img = body[: w * h * depth].reshape(h, w, depth).astype(np.float64)
    return img @ np.array([0.299, 0.587, 0.114]) if depth == 3 else img[:, :, 0]


def encode_pgm(img: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (img.shape[1], img.shape[0]) + np.clip(np.rint(img), 0, 255).astype(np.uint8).tobytes()


def picture_of(vector: list[float] | None, side: int = 8, cell: int = 8) -> bytes | None:
    """A square grey picture of a vector, for tables without images: one cell a number, smoothed; longer vectors make larger ones."""
    v = np.array([0.0 if x is None else x for x in vector or []], dtype=np.float64)
    if not len(v):
        return None
    side = max(side, int(np.ceil(np.sqrt(len(v)))))
    v = np.nan_to_num(np.r_[v, np.zeros(side * side - len(v))])
    span = v.max() - v.min()
    grid = ((v - v.min()) / span if span else v * 0).reshape(side, side) * 255
    return encode_pgm(resize(grid, side * cell, side * cell))


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    y = np.clip((np.arange(h) + 0.5) * img.shape[0] / h - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * img.shape[1] / w - 0.5, 0, img.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    return (img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx) * (1 - fy) + (img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx) * fy


def blur(a: np.ndarray, r: int) -> np.ndarray:
    """Mean of a square of radius r; the border repeats."""
    n = 2 * r + 1
    for axis in (0, 1):
        pad = [(r + 1, r) if axis == k else (0, 0) for k in (0, 1)]
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis)
        a = (c[n:] - c[:-n] if axis == 0 else c[:, n:] - c[:, :-n]) / n
    return a


def describe(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, size, angle) and their descriptors (32 bytes each), strongest first."""
    found = []
    for s in SCALES:
        h, w = round(img.shape[0] * s), round(img.shape[1] * s)
        if min(h, w) < 2 * REACH:
            continue
        level = resize(img, h, w) if s != 1.0 else img
        gy, gx = np.gradient(blur(level, 1))
        a, b, c = blur(gx * gx, 2), blur(gy * gy, 2), blur(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        p = np.pad(r, 1, constant_values=-np.inf)
        around = np.max([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], axis=0)
        y, x = np.nonzero((r > around) & (r > max(1.0, 0.01 * r.max())))
        strong = np.argsort(-r[y, x], kind="stable")[:CORNERS]
        y, x = y[strong], x[strong]
        found.append((level, s, x, y, r[y, x]))
    if not found or not sum(len(f[2]) for f in found):
        return np.zeros((0, 4), dtype=np.float32), np.zeros((0, 32), dtype=np.uint8)
    points, bits, force = [], [], []
    for level, s, x, y, r in found:
        h, w = level.shape
        at = lambda u, v: smooth[np.clip(np.rint(v).astype(int), 0, h - 1), np.clip(np.rint(u).astype(int), 0, w - 1)]  # noqa: B023, E731
        smooth = level
        weight = at(x[:, None] + _DISC[:, 0], y[:, None] + _DISC[:, 1])
        angle = np.arctan2((weight * _DISC[:, 1]).sum(1), (weight * _DISC[:, 0]).sum(1))
        smooth = blur(level, 2)
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        u, v = _PATTERN[:, :, 0], _PATTERN[:, :, 1]
        value = at(x[:, None, None] + cos * u - sin * v, y[:, None, None] + sin * u + cos * v)
        bits.append(np.packbits(value[:, :, 0] < value[:, :, 1], axis=1))
        points.append(np.stack([(x + 0.5) / s, (y + 0.5) / s, np.full(len(x), 1 / s), angle], axis=1))
        force.append(r)
    order = np.argsort(-np.concatenate(force), kind="stable")
    return np.concatenate(points)[order].astype(np.float32), np.concatenate(bits)[order]


def band_keys(bits: np.ndarray, probes: bool = False) -> np.ndarray:
    """Values of the bands of each descriptor (a row); ``probes``: by band, each value and those with a bit turned."""
    value = np.ascontiguousarray(bits).view("<u4")
    return value[:, :, None] ^ _TURNED if probes else value


def bit_order(bits: np.ndarray) -> np.ndarray:
    """An order of the 256 bits in which few descriptors share a band; whatever it is, the tables find the same pairs.

    Bits go, the most even first, to the band in which they part most of a fixed number of pairs that still agree.
    """
    if len(bits) < 2:
        return np.arange(256)
    i, j = np.random.RandomState(7).randint(0, len(bits), (2, PROBED))
    differ = np.unpackbits(bits[i] ^ bits[j], axis=1).T.astype(np.float32)
    room, agree = np.full(BANDS, 256 // BANDS), np.ones((BANDS, PROBED), dtype=np.float32)
    bands: list[list[int]] = [[] for _ in range(BANDS)]
    for bit in np.argsort(-differ.sum(axis=1), kind="stable").tolist():
        k = int(np.argmax(np.where(room > 0, agree @ differ[bit], -1)))
        bands[k].append(bit)
        room[k] -= 1
        agree[k] *= 1 - differ[bit] / 2
    return np.concatenate(bands).astype(np.int64)


def _ordered(bits: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(bits, axis=1)[:, order], axis=1)


def _columns(bits: np.ndarray) -> list[np.ndarray]:
    """The four 64-bit words of all descriptors, each word for itself."""
    return list(np.ascontiguousarray(np.ascontiguousarray(bits).view(np.uint64).T))


class HammingTables:
    """Sorted probes of query descriptors."""

    def __init__(self, bits: np.ndarray):
        self.size, self.order = len(bits), bit_order(bits)
        bits = _ordered(bits, self.order)
        self.columns = _columns(bits)
        probes = band_keys(bits, probes=True)
        self.tables = []
        for k in range(BANDS):
            flat = probes[:, k].ravel()
            order = np.argsort(flat, kind="stable")
            self.tables.append((flat[order], (order // len(_TURNED)).astype(np.int32)))

    def within(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of bits, query descriptor) that differ in RADIUS bits at most, each once."""
        bits = _ordered(bits, self.order)
        rows, values, found = _columns(bits), band_keys(bits), []
        for k, (keys, owner) in enumerate(self.tables):
            by = np.argsort(values[:, k])  # sought in order, neighbours share a cache line
            low, n = np.empty((2, len(by)), dtype=np.int64)
            low[by] = np.searchsorted(keys, values[by, k], side="left")
            n[by] = np.searchsorted(keys, values[by, k], side="right")
            n -= low
            total = np.cumsum(n)
            at = 0
            while at < len(n):
                base = total[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(total, base + CANDIDATES, side="right")))
                i = np.repeat(np.arange(at, stop, dtype=np.int32), n[at:stop])
                j = owner[np.arange(len(i), dtype=np.int32) + np.repeat((low + base + n - total)[at:stop].astype(np.int32), n[at:stop])]
                far = np.zeros(len(i), dtype=np.uint8)
                for pair in ((2, 1), (3, 0)):  # the band's own word last: it tells least
                    for turn in pair:
                        w = (k // 2 + turn) % 4
                        far += np.bitwise_count(rows[w].take(i) ^ self.columns[w].take(j))
                    near = np.flatnonzero(far <= RADIUS)
                    i, j, far = i.take(near), j.take(near), far.take(near)
                found.append(i.astype(np.int64) * self.size + j)
                at = stop
        pairs = np.unique(np.concatenate(found))
        return np.divmod(pairs, max(1, self.size))


def _masks(rows: np.ndarray) -> list[int]:
    """The set columns of each row as bits of one number."""
    return [int.from_bytes(x.tobytes(), "little") for x in np.packbits(rows, axis=1, bitorder="little")]


def _near(at: np.ndarray, pixels: float) -> list[int]:
    """For each point, which ones are within ``pixels`` of it."""
    return _masks(np.linalg.norm(at[:, None] - at, axis=2) <= pixels)


def _places(points: int, near: list[int]) -> int:
    """How many of some points are near none counted before: a corner seen at several scales is one."""
    n = 0
    while points:
        points &= ~near[(points & -points).bit_length() - 1]
        n += 1
    return n


def _proposals(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Scale, rotation, its complex factor and shift of the transform that each match of corners p -> q proposes."""
    scale, turn = (q[..., 2] / p[..., 2]).astype(np.float64), (q[..., 3] - p[..., 3]).astype(np.float64)
    factor = scale * np.exp(1j * turn)
    shift = q[..., 0] + 1j * q[..., 1] - factor * (p[..., 0] + 1j * p[..., 1])
    return [scale, turn, factor, shift.real, shift.imag]


def _carried(p: np.ndarray, q: np.ndarray, moves: list[np.ndarray], pixels: float) -> np.ndarray:
    """Which matches (last axis) each proposed transform carries."""
    scale, _, factor, dx, dy = (x[..., None] for x in moves)
    px, py, qx, qy = (x[..., None, :].astype(np.float64) for x in (p[..., 0], p[..., 1], q[..., 0], q[..., 1]))
    x, y = factor.real * px - factor.imag * py + dx - qx, factor.imag * px + factor.real * py + dy - qy
    return x * x + y * y <= (pixels * np.maximum(1.0, scale)) ** 2


def consensus(p: np.ndarray, a: np.ndarray, q: np.ndarray, b: np.ndarray, radius: int, pixels: float = 3.0, least: int = 1) -> tuple[int, float, float, float, float]:
    """Largest number of places of corners of one image that one similarity transform carries to matching corners of the other; 0 below ``least``.

    Returns it with scale, rotation (degrees) and shift of the transform.
    """
    if not len(a) or not len(b):
        return 0, 1.0, 0.0, 0.0, 0.0
    far = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2)
    i, j = np.nonzero(far <= radius)
    best = (0, 1.0, 0.0, 0.0, 0.0)
    if not len(i):
        return best
    moves = _proposals(p[i], q[j])
    scale, turn, _, dx, dy = moves
    sides = [np.unique(x, return_inverse=True) for x in (i, j)]
    held: list[list[int]] = [[], []]
    count = np.zeros(len(i), dtype=np.int64)
    for s in range(0, len(i), step := max(1, CANDIDATES // len(i))):
        m = slice(s, s + step)
        agree = _carried(p[i], q[j], [x[m] for x in moves], pixels)
        rows, at = np.nonzero(agree)
        sizes = []
        for (names, place), masks in zip(sides, held, strict=True):
            seen = np.zeros((len(agree), len(names)), dtype=bool)
            seen[rows, place[at]] = True
            sizes.append(seen.sum(axis=1))
            masks += _masks(seen)
        count[m] = np.minimum(*sizes)
    if count.max() < least:
        return best
    close = [_near(points[names, :2], pixels) for points, (names, _) in zip((p, q), sides, strict=True)]
    first = len(i)
    for m in np.argsort(-count, kind="stable").tolist():  # places are never more than matches
        if count[m] < max(least, best[0]):
            break
        n = min(_places(masks[m], near) for masks, near in zip(held, close, strict=True))
        if n > best[0] or (n == best[0] and m < first):
            first, best = m, (n, float(scale[m]), float(np.degrees(turn[m])) % 360, float(dx[m]), float(dy[m]))
    return best


def find_copies(df: DataFrame, image: Column, row_id: str, is_query: Column, min_corners: int = 4) -> DataFrame:
    """Search every image for copies of the query images, cropped or edited.

    Returns rows of two kinds. 'member': image_id, class_id (the smallest id
    of the same bytes; its own for null or unreadable images), is_query. 'match':
    image_id = class_id = a class that holds a query, match_class another class,
    corners that agree, scale, rotation, dx, dy. Copies are not expanded into
    pairs. Images without corners match their class only. Rows repeat as they
    come; other columns are ignored; an empty table gives an empty table.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(f"`{row_id}`").cast("long").alias("image_id"), image.alias("image"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    features = scratch.write(_features(rows), "features")
    classes = features.where("digest is not null").groupBy("digest").agg(F.min("image_id").alias("class_id"), F.max("is_query").alias("asks"))
    classes = scratch.write(classes, "classes")
    members = features.select("image_id", "digest", "is_query").join(classes, "digest", "left").select("image_id", F.coalesce("class_id", "image_id").alias("class_id"), "is_query")
    none = "cast(null as long) match_class, cast(null as int) corners, cast(null as double) scale, cast(null as double) rotation, cast(null as double) dx, cast(null as double) dy"
    out = members.selectExpr("'member' kind", "image_id", "class_id", "is_query", *none.split(", "))
    asked = features.where("is_query and length(bits) > 0").dropDuplicates(["digest"]).join(classes.select("digest", F.col("class_id").alias("q")), "digest")
    asked = scratch.write(asked.select("q", "corners", "bits"), "asked")
    shelf = features.where("length(bits) > 0").select("digest", "corners", "bits")
    for block in _blocks(asked):
        match = scratch.write(_matches(shelf, block, min_corners), "match").dropDuplicates(["q", "digest"])
        match = match.join(classes.select("digest", "class_id"), "digest").where("q <> class_id")
        out = out.unionByName(match.selectExpr("'match' kind", "q image_id", "q class_id", "true is_query", "class_id match_class", "corners", "scale", "rotation", "dx", "dy"))
    return out


def _blocks(asked: DataFrame):
    """Query images, as (ids, corners, bits) of about BLOCK descriptors."""
    block, held = [], 0
    for row in asked.toLocalIterator():
        block.append((row.q, bytes(row.corners), bytes(row.bits)))
        held += len(row.bits) // 32
        if held >= BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def _features(rows: DataFrame) -> DataFrame:
    names = ("image_id", "is_query", "digest", "corners", "bits")
    types = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())

    def run(batches):
        import hashlib

        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                digest, corners, bits = [], [], []
                for data in part.column(1).to_pylist():
                    img = decode_image(data)
                    p, b = describe(img) if img is not None else (np.zeros((0, 4), dtype=np.float32), np.zeros((0, 32), dtype=np.uint8))
                    digest.append(None if img is None else hashlib.sha256(data).digest())
                    corners.append(p.tobytes())
                    bits.append(b.tobytes())
                columns = (part.column(0), part.column(2), digest, corners, bits)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.mapInArrow(run, "image_id long, is_query boolean, digest binary, corners binary, bits binary")


def _matches(shelf: DataFrame, block: list[tuple[int, bytes, bytes]], min_corners: int) -> DataFrame:
    """q, digest and transform of all copies of a block's queries; a digest repeats at most once a task."""
    shared = shelf.sparkSession.sparkContext.broadcast(block)  # about BLOCK descriptors

    def run(batches):
        points = [np.frombuffer(x[1], dtype=np.float32).reshape(-1, 4) for x in shared.value]
        bits = [np.frombuffer(x[2], dtype=np.uint8).reshape(-1, 32) for x in shared.value]
        query = np.repeat(np.arange(len(bits)), [len(b) for b in bits])
        every, tables, seen = np.concatenate(points), HammingTables(np.concatenate(bits)), set()
        for batch in batches:
            for s in range(0, batch.num_rows, 100):
                rows, fresh = [], []
                for digest, p, b in zip(*[x.to_pylist() for x in batch.slice(s, 100).columns], strict=True):
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        fresh.append((digest, np.frombuffer(p, dtype=np.float32).reshape(-1, 4), np.frombuffer(b, dtype=np.uint8).reshape(-1, 32)))
                if fresh:
                    image = np.repeat(np.arange(len(fresh)), [len(x[2]) for x in fresh])
                    i, j = tables.within(np.concatenate([x[2] for x in fresh]))
                    for c, q in likely(image[i] * len(bits) + query[j], j, i, every, np.concatenate([x[1] for x in fresh]), min_corners, len(bits)):
                        n, *rest = consensus(points[q], bits[q], fresh[c][1], fresh[c][2], RADIUS, least=min_corners)
                        if n >= min_corners:
                            rows.append((shared.value[q][0], fresh[c][0], n, *rest))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
                types = (pa.int64(), pa.binary(), pa.int32(), *[pa.float64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["q", "digest", "corners", "scale", "rotation", "dx", "dy"])

    return shelf.mapInArrow(run, "q long, digest binary, corners int, scale double, rotation double, dx double, dy double")


def likely(group: np.ndarray, ours: np.ndarray, theirs: np.ndarray, p: np.ndarray, q: np.ndarray, least: int, width: int, pixels: float = 3.0):
    """Groups (row, column of ``width`` columns) of matches p[ours] -> q[theirs] of which one carries ``least`` places; large ones unseen."""
    order = np.lexsort((theirs, ours, group))
    group, ours, theirs = group[order], ours[order], theirs[order]
    names, first, size = np.unique(group, return_index=True, return_counts=True)
    for g in names[size > 32].tolist():
        yield divmod(g, width)
    for k in range(least, 33):
        starts = first[size == k]
        step = max(1, CANDIDATES // (k * k))
        for s in range(0, len(starts), step):
            at = starts[s : s + step, None] + np.arange(k)
            a, b = p[ours[at]], q[theirs[at]]  # groups, matches, (x, y, size, angle)
            agree = _carried(a, b, _proposals(a, b), pixels)
            hit = agree.sum(axis=2).max(axis=1) >= least
            at, a, b, agree = at[hit], a[hit], b[hit], agree[hit]
            n = np.minimum(_all_places(agree, ours[at], a, pixels), _all_places(agree, theirs[at], b, pixels))
            for g in group[at[n.max(axis=1, initial=0) >= least, 0]].tolist():
                yield divmod(g, width)


def _all_places(agree: np.ndarray, name: np.ndarray, points: np.ndarray, pixels: float) -> np.ndarray:
    """Places of the points that each transform of each group carries, as ``_places`` counts them: in order of their names."""
    order = np.argsort(name, axis=1, kind="stable")
    at = np.take_along_axis(points[..., :2], order[..., None], axis=1)
    near = np.linalg.norm(at[:, :, None] - at[:, None], axis=3) <= pixels
    agree = np.take_along_axis(agree, order[:, None], axis=2)
    picked = np.zeros_like(agree)
    for t in range(agree.shape[2]):
        picked[:, :, t] = agree[:, :, t] & ~(picked[:, :, :t] & near[:, None, :t, t]).any(axis=2)
    return picked.sum(axis=2)


def picture_column(df: DataFrame, vector: str) -> DataFrame:
    """The frame with a column ``picture`` (binary) drawn from an array of numbers."""
    @F.pandas_udf("binary")
    def draw(v: pd.Series) -> pd.Series:
        return v.map(lambda x: picture_of(None if x is None else list(x)))

    return df.withColumn("picture", draw(F.col(f"`{vector}`")))
