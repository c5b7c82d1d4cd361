"""Batch twins of the per-key state machines: tracker, cooldown, votes, rates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.matching import CORNERS, assignment, assignments

#: Weights of the assignment's cost.
IOU_WEIGHT, CENTER_WEIGHT = 0.75, 0.25


#: Cost of a pair outside the gate, and the cost from which a pair of the assignment is none (fixed values).
OUTSIDE, NO_PAIR = 1e6, 1e5


def pair_costs(foreseen: np.ndarray, boxes: np.ndarray, least_iou: float, most_distance: float) -> np.ndarray:
    """(..., track, box) from corners (..., track, 4) and (..., box, 4): the cost of each pair, ``OUTSIDE`` beyond the gate."""
    a, b = foreseen[..., :, None, :], boxes[..., None, :, :]
    size = lambda x: (x[..., 2] - x[..., 0], x[..., 3] - x[..., 1])
    across, down = (np.clip(np.minimum(a[..., i + 2], b[..., i + 2]) - np.maximum(a[..., i], b[..., i]), 0, None) for i in (0, 1))
    both = across * down
    union = np.multiply(*size(a)) + np.multiply(*size(b)) - both
    overlap = np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)
    x, y = ((a[..., i] + a[..., i + 2]) / 2 - (b[..., i] + b[..., i + 2]) / 2 for i in (0, 1))
    away = np.sqrt(x * x + y * y) / np.maximum(1.0, np.maximum(np.hypot(*size(a)), np.hypot(*size(b))))
    inside = (overlap >= least_iou) | (away <= most_distance)
    return np.where(inside, 1 - (IOU_WEIGHT * overlap + CENTER_WEIGHT * np.clip(1 - away / most_distance, 0, None)), OUTSIDE)


@dataclass
class Track:
    id: int
    box: np.ndarray
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(2))
    hits: int = 1
    missed: int = 0
    age: int = 1


@dataclass
class Tracker:
    """Tracks of one key; ``step`` takes a frame's boxes and returns (track id, hits, stable) for each."""

    least_iou: float = 0.3
    most_distance: float = 2.0
    patience: int = 12
    stable_hits: int = 3
    tracks: list[Track] = field(default_factory=list)
    last_id: int = 0

    def step(self, boxes: np.ndarray, shift: tuple[float, float] = (0.0, 0.0)) -> list[tuple[int, int, bool]]:
        """``shift`` is the camera's motion since the frame before: it moves what is foreseen and is no velocity of a track."""
        out: list[tuple[int, int, bool] | None] = [None] * len(boxes)
        seen: set[int] = set()
        older = len(self.tracks)
        if older and len(boxes):
            cost = self.costs(boxes, shift)
            for i, j in assignment(cost):
                if cost[i, j] < NO_PAIR:
                    self._advance(self.tracks[i], boxes[j], np.array(shift))
                    seen.add(i)
                    out[j] = (self.tracks[i].id, self.tracks[i].hits, self.tracks[i].hits >= self.stable_hits)
        for j, box in enumerate(boxes):
            if out[j] is None:
                self.last_id += 1
                self.tracks.append(Track(self.last_id, box))
                out[j] = (self.last_id, 1, self.stable_hits <= 1)
        for i, track in enumerate(self.tracks[:older]):
            track.age += 1
            track.missed += i not in seen
        self.tracks = [t for t in self.tracks if t.missed <= self.patience]
        return out

    def costs(self, boxes: np.ndarray, shift: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
        """The cost of each pair of a track and a box; ``OUTSIDE`` where neither overlap nor distance is inside the gate."""
        moves = [t.velocity * (t.missed + 1) + np.array(shift) for t in self.tracks]
        foreseen = np.array([t.box + np.tile(m, 2) for t, m in zip(self.tracks, moves, strict=True)]).reshape(-1, 4)
        return pair_costs(foreseen, boxes, self.least_iou, self.most_distance)

    @staticmethod
    def _advance(track: Track, box: np.ndarray, shift: np.ndarray) -> None:
        moved = ((box[:2] + box[2:] - track.box[:2] - track.box[2:]) / 2 - shift) / (track.missed + 1)
        track.velocity = moved if track.hits == 1 else 0.65 * track.velocity + 0.35 * moved
        track.box, track.missed = box, 0
        track.hits += 1


#: Rows that a task takes through its trackers at once, pairs of a track and a box in one block of them, and how many trackers are too few to go in step.
ROWS_AT_ONCE, PAIRS_AT_ONCE, FEW = 1 << 17, 1 << 16, 3


@dataclass
class Tracks:
    """The tracks of many trackers, those of one in their order behind each other; ``of`` tells which (rising)."""

    of: np.ndarray
    box: np.ndarray
    velocity: np.ndarray
    id: np.ndarray
    hits: np.ndarray
    missed: np.ndarray

    @classmethod
    def new(cls, of: np.ndarray, box: np.ndarray, number: np.ndarray) -> Tracks:
        return cls(of, box, np.zeros((len(of), 2)), number, np.ones(len(of), int), np.zeros(len(of), int))

    @classmethod
    def of_one(cls, of: int, tracks: list[Track]) -> Tracks:
        box, velocity = (np.array([getattr(t, c) for t in tracks], float).reshape(-1, n) for c, n in (("box", 4), ("velocity", 2)))
        return cls(np.full(len(tracks), of), box, velocity, *(np.array([getattr(t, c) for t in tracks], int) for c in ("id", "hits", "missed")))

    def as_list(self) -> list[Track]:
        return [Track(*(v[i] for v in (self.id, self.box, self.velocity, self.hits, self.missed))) for i in range(len(self.of))]

    def taken(self, rows: np.ndarray | slice) -> Tracks:
        return Tracks(*(v[rows] for v in vars(self).values()))

    def joined(self, other: Tracks) -> Tracks:
        """Both, the other's tracks last in each tracker."""
        order = np.argsort(np.concatenate([self.of, other.of]), kind="stable")
        return Tracks(*(np.concatenate([a, b])[order] for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from each start on in a row of their own, and which of them are within its count; the others are 0."""
    place = np.arange(counts.max(initial=0))
    real = place < counts[:, None]
    return np.where(real, starts[:, None] + place, 0), real


def _matched(tracks: Tracks, first: np.ndarray, held: np.ndarray, boxes: np.ndarray, begin: np.ndarray, count: np.ndarray, rules: Tracker) -> tuple[np.ndarray, np.ndarray]:
    """Tracks and boxes that are assigned to each other, of trackers with ``held`` tracks from ``first`` on and ``count`` boxes from ``begin`` on."""
    at, is_track = _spread(first, held)
    row, is_box = _spread(begin, count)
    foreseen = tracks.box + np.tile(tracks.velocity * (tracks.missed[:, None] + 1), 2)
    cost = np.where(is_track[:, :, None] & is_box[:, None], pair_costs(foreseen[at], boxes[row], rules.least_iou, rules.most_distance), np.inf)
    turned = held > count
    fewer = np.minimum(held, count)
    n = fewer.max()
    problems = np.full((len(held), n, max(cost.shape[1:])), np.inf)
    problems[~turned, :, : cost.shape[2]] = cost[~turned, :n]
    problems[turned, :, : cost.shape[1]] = cost[turned, :, :n].swapaxes(1, 2)
    owner = assignments(problems, fewer)
    k, j = np.nonzero(owner >= 0)
    i = owner[k, j]
    i, j = np.where(turned[k], j, i), np.where(turned[k], i, j)
    good = cost[k, i, j] < NO_PAIR
    return at[k, i][good], row[k, j][good]


def steps(boxes: np.ndarray, frames: np.ndarray, keys: np.ndarray, tracks: Tracks, last_id: int) -> tuple[np.ndarray, np.ndarray, Tracks, int]:
    """``Tracker`` over many keys, all of them a frame on at a time: (track id, hits) of each box, and the last key's tracks and last id.

    Frame f has the boxes from ``frames[f]`` up to the next; key k has the frames from ``keys[k]`` up to the next.
    ``tracks`` and ``last_id`` are what the first key holds already.
    """
    rules = Tracker()
    first, lengths = keys[:-1], np.diff(keys)
    ranks = np.argsort(-lengths, kind="stable")  # keys with most frames first: those still on are always the first ones
    first, lengths = first[ranks], lengths[ranks]
    last = int(np.flatnonzero(ranks == len(ranks) - 1)[0])
    begun = int(np.flatnonzero(ranks == 0)[0])
    tracks = tracks.taken(slice(None))
    tracks.of = np.full(len(tracks.of), begun)
    ids = np.zeros(len(ranks), int)
    ids[begun] = last_id
    number, hits = np.zeros(len(boxes), int), np.ones(len(boxes), int)
    left = tracks
    for t in range(lengths[0]):
        on = int(np.searchsorted(-lengths, -t))
        tracks = tracks.taken(slice(np.searchsorted(tracks.of, on)))
        if on < FEW:
            for k in range(on):
                one = Tracker(tracks=tracks.taken(tracks.of == k).as_list(), last_id=int(ids[k]))
                for begin, end in zip(frames[first[k] + t : first[k] + lengths[k]], frames[first[k] + t + 1 : first[k] + lengths[k] + 1], strict=True):
                    number[begin:end], hits[begin:end], _ = zip(*one.step(boxes[begin:end]), strict=True)
                if k == last:
                    left, ids[k] = Tracks.of_one(k, one.tracks), one.last_id
            break
        held = np.bincount(tracks.of, minlength=on)
        start = np.cumsum(held) - held
        begin = frames[first[:on] + t]
        count = frames[first[:on] + t + 1] - begin
        seen = np.zeros(len(tracks.of), bool)
        size = np.maximum(held, count)
        todo = np.flatnonzero(held > 0)
        todo = todo[np.argsort(-size[todo])]
        while todo.size:  # trackers of about the same size go together
            k = todo[: max(1, PAIRS_AT_ONCE // int(size[todo[0]]) ** 2)]
            todo = todo[len(k) :]
            own, found = _matched(tracks, start[k], held[k], boxes, begin[k], count[k], rules)
            seen[own] = True
            number[found] = tracks.id[own]
            hits[found] = tracks.hits[own] + 1
            box = boxes[found]
            moved = (box[:, :2] + box[:, 2:] - tracks.box[own, :2] - tracks.box[own, 2:]) / 2 / (tracks.missed[own, None] + 1)
            tracks.velocity[own] = np.where(tracks.hits[own, None] == 1, moved, 0.65 * tracks.velocity[own] + 0.35 * moved)
            tracks.box[own], tracks.hits[own], tracks.missed[own] = box, hits[found], 0
        row, real = _spread(begin, count)
        fresh = real & (number[row] == 0)
        of = np.nonzero(fresh)[0]
        given = (ids[:on, None] + np.cumsum(fresh, 1))[fresh]
        ids[:on] += fresh.sum(1)
        number[row[fresh]] = given
        tracks.missed += ~seen
        tracks = tracks.taken(tracks.missed <= rules.patience).joined(Tracks.new(of, boxes[row[fresh]], given))
        if lengths[last] == t + 1:
            left = tracks.taken(tracks.of == last)
    return number, hits, left, int(ids[last])


def tracked(boxes: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, frame, id, track_id, hits, stable) for boxes (key, frame, id, corners), frames in order, boxes by id, then corners.

    Keys pass sorted through their tasks, many of them in step; a task holds some rows, one frame and the tracks of
    one key. A null key is one of its own.
    """
    types = dict(boxes.dtypes)
    rows = boxes.select(F.col(key).alias("key"), F.col(frame).alias("frame"), "id", *CORNERS).repartition("key").sortWithinPartitions("key", "frame", "id", *CORNERS)
    stable = Tracker().stable_hits

    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Tracks.new(np.zeros(0, int), np.zeros((0, 4)), np.zeros(0, int))
        now, tracks, last_id = None, nothing, 0

        def step(table: pa.Table, whole: bool) -> tuple[int, pa.RecordBatch | None]:
            """The rows of all frames, without the last one unless ``whole``: it may go on in the next batch."""
            nonlocal now, tracks, last_id
            key_code = codes(table["key"])
            new_key = np.diff(key_code, prepend=-1) != 0
            new_frame = new_key | (np.diff(codes(table["frame"]), prepend=-1) != 0)
            frames = np.append(np.flatnonzero(new_frame), len(table))
            if not whole:
                frames = frames[:-1]
            done = int(frames[-1])
            if not done:
                return 0, None
            keys = np.append(np.flatnonzero(new_key[frames[:-1]]), len(frames) - 1)
            if now != (table["key"][0].as_py(),):
                tracks, last_id = nothing, 0
            corners = np.column_stack([np.asarray(table[c], float) for c in CORNERS])
            number, hits, tracks, last_id = steps(corners[:done], frames, keys, tracks, last_id)
            now = (table["key"][done - 1].as_py(),)
            part = [table[c].slice(0, done).combine_chunks() for c in ("key", "frame", "id")]
            added = [pa.array(number, pa.int32()), pa.array(hits, pa.int32()), pa.array(hits >= stable)]
            return done, pa.RecordBatch.from_arrays([*part, *added], ["key", "frame", "id", "track_id", "hits", "stable"])

        held: list[pa.RecordBatch] = []
        n, enough = 0, ROWS_AT_ONCE
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= enough:
                table = pa.Table.from_batches(held)
                done, out = step(table, False)
                if out is not None:
                    yield out
                held, n = table.slice(done).to_batches(), n - done
                enough = max(ROWS_AT_ONCE, 2 * n)
        if n:
            yield step(pa.Table.from_batches(held), True)[1]

    done = rows.mapInArrow(run, f"key {types[key]}, frame {types[frame]}, id {types['id']}, track_id int, hits int, stable boolean")
    return done.withColumnsRenamed({"key": key, "frame": frame})


def cooled_down(events: DataFrame, keys: list[str], at: str, order: str, seconds: float) -> DataFrame:
    """``events`` that are announced: the first of a key, then each at least ``seconds`` after the last announced one. Keys pass sorted through their tasks, which hold one time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0.0
        for batch in batches:
            keep = []
            for key, time in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(at).to_pylist(), strict=True):
                fire = key != now or time - last >= seconds
                if fire:
                    now, last = key, time
                keep.append(fire)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return events.repartition(*keys).sortWithinPartitions(*keys, at, order).mapInArrow(run, events.schema)


def decayed_votes(events: DataFrame, key: str, label: str, weight: Column, order: list[str], decay: float = 0.75) -> DataFrame:
    """(key, label, score): the sum of weights, each decayed once for every later event of the key."""
    w = W.partitionBy(key)
    later = F.count("*").over(w) - F.row_number().over(w.orderBy(*order))
    return events.withColumn("_w", weight * F.pow(F.lit(decay), later)).groupBy(key, label).agg(F.round(F.sum("_w"), 9).alias("score"))


def trailing_rate(events: DataFrame, key: str, seconds: Column, window: float = 1.5) -> DataFrame:
    """``events`` with ``rate``: (n - 1) / span of the key's events in the trailing window; n if there is one."""
    w = W.partitionBy(key).orderBy("_us").rangeBetween(-round(window * 1e6), 0)
    rows = events.withColumn("_us", F.round(seconds * 1e6).cast("long"))
    n, span = F.count("*").over(w), (F.col("_us") - F.min("_us").over(w)) / 1e6
    return rows.withColumn("rate", F.when(n <= 1, n.cast("double")).otherwise((n - 1) / F.greatest(F.lit(0.001), span))).drop("_us")


def latest(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key; a partial aggregate, not a window."""
    others = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in others])


def carried_forward(events: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``events`` with the last value not null up to each."""
    return events.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
