"""Best-fit packing of documents into token sequences by bin completion."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .slots import with_rank

CAPACITY = 2048
NAME = "byte_bpe_50k"
END = 0
#: Search steps of the branch-and-bound on the histogram of lengths.
STEPS = 20_000
#: Fillings looked at around one largest document.
CHOICES = 64


# --- tokens -----------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _encoders(ranks_path: str, json_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
    return fast, Tokenizer.from_file(json_path)


def installed(kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{NAME}.{kind}")


def token_ids(text: str, ranks_path: str, json_path: str) -> list[int]:
    """Ids as ``Tokenizer.from_file(json_path).encode(text, add_special_tokens=False)`` has them.

    The same vocabulary as ranks is about four times as fast and gives the same
    ids; where its engine refuses a text, the tokenizer itself encodes it.
    """
    fast, exact = _encoders(ranks_path, json_path)
    try:
        return fast.encode(text, allowed_special="all")
    except BaseException as refused:  # the engine's own panics are no Exceptions
        if isinstance(refused, (KeyboardInterrupt, SystemExit)):
            raise
        return exact.encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int) -> list[int]:
    """Bounds of the pieces of ``n`` tokens: whole capacities, but for the first piece."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]


def pieces(docs: DataFrame, capacity: int, ranks_path: str | None, json_path: str | None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's tokens and an end id, cut.

    Without paths, each worker looks for the vocabulary of ``NAME`` where it runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, json = (str(p or installed(kind)) for p, kind in ((ranks_path, "tiktoken"), (json_path, "json")))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = token_ids(text, ranks, json) if text else []
                ids.append(END)
                raw, bounds = np.array(ids, "<u4").tobytes(), cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# --- the plan: patterns of lengths and how often each is used -----------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs (Martello and Toth's bound over all thresholds)."""
    by_size = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        by_size[length] += n
    number = np.concatenate([[0], np.cumsum(by_size)])  # number[k]: of lengths below k
    mass = np.concatenate([[0], np.cumsum(by_size * np.arange(capacity + 1))])
    best = -(-int(mass[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        large = int(number[-1] - number[capacity - k + 1])
        half = int(number[capacity - k + 1] - number[capacity // 2 + 1])
        half_mass = int(mass[capacity - k + 1] - mass[capacity // 2 + 1])
        small_mass = int(mass[capacity // 2 + 1] - mass[k])
        best = max(best, large + half + max(0, -(-(small_mass - (half * capacity - half_mass)) // capacity)))
    return best


def _best_fit(room: int, counts: dict[int, int], lengths: list[int]) -> tuple[int, ...]:
    out = []
    for length in lengths:
        take = min(room // length, counts.get(length, 0)) if length <= room else 0
        out += [length] * take
        room -= take * length
    return tuple(out)


def fillings(room: int, counts: dict[int, int], lengths: list[int], limit: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings of ``room``, least waste first, and whether these are all.

    At most ``limit`` are listed.

    A filling is dominated when something unused still fits, or when one unused
    length could stand for two of its members without exceeding the room: the
    freed two fit wherever the one would have gone.  The best fit, largest
    first, is always among them.
    """
    found: dict[tuple[int, ...], None] = {_best_fit(room, counts, lengths): None}
    fits = [x for x in lengths if x <= room and counts.get(x, 0)]
    budget = [40 * limit]

    def extend(chosen: list[int], left: int, at: int) -> None:
        if len(found) >= limit or budget[0] <= 0:
            return
        budget[0] -= 1
        k, taken = at, False
        while k < len(fits) and len(found) < limit and budget[0] > 0:
            length = fits[k]
            if length <= left and chosen.count(length) < counts[length]:
                taken = True
                extend([*chosen, length], left - length, k)
            k += 1
        if not taken:
            found[tuple(chosen)] = None

    extend([], room, 0)

    def dominated(filling: tuple[int, ...]) -> bool:
        waste = room - sum(filling)
        used = {x: filling.count(x) for x in filling}
        spare = [x for x in fits if counts[x] > used.get(x, 0)]
        pairs = {filling[i] + filling[j] for i in range(len(filling)) for j in range(i)}
        return any(s <= x <= s + waste for s in pairs for x in spare)

    ranked = sorted(found, key=lambda f: (room - sum(f), len(f)))
    return [f for i, f in enumerate(ranked) if i == 0 or not dominated(f)], len(found) < limit and budget[0] > 0


def _repeat(filling: tuple[int, ...], counts: dict[int, int]) -> int:
    return min(counts[x] // filling.count(x) for x in set(filling))


def _greedy(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    counts, plan = dict(counts), []
    lengths = sorted(counts, reverse=True)
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        bin_ = (largest, *_best_fit(capacity - largest, counts, lengths))
        counts[largest] += 1
        times = _repeat(bin_, counts)
        for x in set(bin_):
            counts[x] -= times * bin_.count(x)
        plan.append((bin_, times))
        lengths = [x for x in lengths if counts[x]]
    return plan


@dataclass(frozen=True)
class Packing:
    """``bins`` as ``(lengths of one sequence, how many)``, what any packing needs, and whether no better one exists."""

    bins: list[tuple[tuple[int, ...], int]]
    bound: int
    least: bool

    @property
    def size(self) -> int:
        return sum(n for _, n in self.bins)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Packing:
    """A packing that uses ``counts`` up, in as few sequences as the search finds.

    Works on the histogram of lengths, which has at most ``capacity`` entries
    however many documents there are.  Best fit gives the first incumbent.
    Branch and bound then completes the sequence of the largest remaining
    length in every undominated way, least waste first, as often as the counts
    allow and then once less at a time, down to once; a branch ends when its waste
    leaves no room for a better total than the incumbent's.  A sequence filled
    otherwise follows a run of equal ones, so that no run is entered in two halves.
    It stops at the lower bound, when nothing is left to try, or after ``steps``;
    ``least`` is false only where ``steps`` or the limits on fillings ended it above
    the bound, and then ``size - bound`` is the most that could be gained.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    best = _greedy(counts, capacity)
    size = sum(n for _, n in best)
    bound, total = lower_bound(counts, capacity), sum(k * v for k, v in counts.items())
    whole = True

    def options(last: tuple[int, ...] | None) -> Iterator[tuple[tuple[int, ...], int]]:
        nonlocal whole
        largest = max(counts)
        counts[largest] -= 1
        lengths = sorted((k for k, v in counts.items() if v), reverse=True)
        found, all_ = fillings(capacity - largest, counts, lengths, CHOICES)
        counts[largest] += 1
        whole = whole and all_
        bins = [(largest, *f) for f in found]
        return ((bin_, times) for bin_ in bins if bin_ != last for times in range(_repeat(bin_, counts), 0, -1))

    def move(choice: tuple[tuple[int, ...], int], sign: int) -> None:
        bin_, times = choice
        for x in set(bin_):
            counts[x] = counts.get(x, 0) + sign * times * bin_.count(x)
            if not counts[x]:
                del counts[x]

    # One set of counts, changed on the way down and back.
    stack, plan, used, waste = [options(None)] if size > bound else [], [], 0, 0
    while stack and steps > 0 and size > bound:
        steps -= 1
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            if plan:
                bin_, times = plan.pop()
                move((bin_, times), 1)
                used, waste = used - times, waste - times * (capacity - sum(bin_))
            continue
        bin_, times = choice
        more = times * (capacity - sum(bin_))
        if waste + more > (size - 1) * capacity - total:
            continue
        move(choice, -1)
        if counts:
            plan.append(choice)
            used, waste = used + times, waste + more
            stack.append(options(bin_))
        else:
            if used + times < size:
                best, size = [*plan, choice], used + times
            move(choice, 1)
    return Packing(best, bound, size == bound or (whole and not stack))


def _lookup(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, its ranks in runs: where a run starts and which sequences it fills."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for bin_, times in plan:
        offset = 0
        for length in dict.fromkeys(bin_):
            uses = bin_.count(length)
            start = taken.get(length, 0)
            runs.setdefault(length, []).append((start, base, uses, offset))
            taken[length] = start + uses * times
            offset += uses * length
        base += times
    names = ("first", "base", "uses", "offset")
    return {k: dict(zip(names, np.array(v, np.int64).T)) for k, v in runs.items()}


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    ranks_path: str | None = None,
    json_path: str | None = None,
) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and one end id; longer ones are cut into whole
    sequences, but for a shorter first piece.  Only the histogram of lengths
    (at most ``capacity`` rows) reaches the driver; the plan made from it is
    applied by each piece's rank among those of its length.

    Null and empty texts have one token, the end id; null ``doc_id`` stays null;
    repeated rows are packed each; an empty table gives no rows; other columns
    are not read.
    """
    cut = staged(
        pieces(docs, capacity, ranks_path, json_path).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    lookup = _lookup(bin_completion(counts, capacity).bins)

    ranked = with_rank(cut, "length", "rank", sum(counts.values()), min(len(counts), 64) or 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths):
                at = lengths == length
                run = lookup[int(length)]
                k = np.searchsorted(run["first"], ranks[at], "right") - 1
                nth = ranks[at] - run["first"][k]
                sequence[at] = run["base"][k] + nth // run["uses"][k]
                offset[at] = run["offset"][k] + nth % run["uses"][k] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    narrow = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return narrow.mapInArrow(
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
