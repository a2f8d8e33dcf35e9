"""Best-k scoring of Arrow blocks: the numeric inner step of the vector search.

Spark decides which catalog rows meet which queries; these helpers only multiply
one block of catalog vectors with one block of query vectors and keep, per
query, the k best rows ordered by (score descending, id ascending). Memory is
bounded by the block sizes and by k rows per query, whatever the catalog size.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS_AT_ONCE = 2_000_000  # scores held at a time: 8 MB of floats
PIECE_ROWS = 8_192         # catalog rows scored at a time
WIDE_AT_ONCE = 1 << 17     # numbers of vectors scored in double precision at a time
GROUP_ROWS = 16            # catalog rows of which the best one stands for all where a first bar is set
OUT_ROWS = 65_536


@dataclass
class QueryBlock:
    keys: pa.Table          # columns carried to the output, one row per query
    vectors: np.ndarray     # unit rows
    price_min: np.ndarray
    price_max: np.ndarray
    floor: np.ndarray       # scores below it cannot be among the k best
    price_min_off: float
    price_max_off: float


def unit_rows(column, dim: int) -> np.ndarray:
    """List column of equal-length vectors as a matrix of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = flat.reshape(len(column), dim)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / norms[:, None]


def query_block(table: pa.Table, keys: list[str], dim: int, off: tuple[float, float]) -> QueryBlock:
    number = lambda c: table.column(c).to_numpy().astype(np.float64)
    return QueryBlock(
        keys=table.select(keys),
        vectors=unit_rows(table.column("vector"), dim),
        price_min=number("price_min"),
        price_max=number("price_max"),
        floor=number("floor"),
        price_min_off=off[0],
        price_max_off=off[1],
    )


@dataclass
class CatalogBlock:
    columns: pa.Table       # id and payload, ordered by id
    rows: np.ndarray        # vectors as they came, not copied where Arrow has them in one piece
    norms: np.ndarray
    narrow: np.ndarray      # unit rows in single precision
    price: np.ndarray

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """Some rows as unit rows."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.rows[at].astype(np.float64) / self.norms[at, None]


def in_order(table: pa.Table) -> pa.Table:
    """The table by id, in one piece; itself where it is so already."""
    order = pc.sort_indices(table.column("id")).to_numpy()
    if not (order[1:] > order[:-1]).all():
        table = table.take(pa.array(order))
    return table.combine_chunks()


def catalog_block(table: pa.Table, dim: int, payload: list[str]) -> CatalogBlock:
    table = in_order(table)
    column = table.column("embedding")
    column = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)
    norms, narrow = np.empty(len(rows)), np.empty(rows.shape, np.float32)
    for start in range(0, len(rows), PIECE_ROWS):
        piece = slice(start, start + PIECE_ROWS)
        wide = rows[piece].astype(np.float64)
        norms[piece] = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        with np.errstate(divide="ignore", invalid="ignore"):
            narrow[piece] = wide / norms[piece, None]
    return CatalogBlock(table.select(["id", *payload]), rows, norms, narrow, table.column("price").to_numpy().astype(np.float64))


def part_of(q: QueryBlock, who) -> QueryBlock:
    """Some queries of a block; `who` is a slice or row numbers."""
    return QueryBlock(q.keys, q.vectors[who], q.price_min[who], q.price_max[who], q.floor[who], q.price_min_off, q.price_max_off)


def _price_allowed(q: QueryBlock, price: np.ndarray, who=None) -> np.ndarray | None:
    """Whether each query allows each price; with `who`, whether query who[i] allows price[i]."""
    low, high = q.price_min, q.price_max
    low_on, high_on = low > q.price_min_off, high < q.price_max_off
    if not (low_on.any() or high_on.any()):
        return None
    if who is None:
        low, high, low_on, high_on, price = low[:, None], high[:, None], low_on[:, None], high_on[:, None], price[None, :]
    else:
        low, high, low_on, high_on = low[who], high[who], low_on[who], high_on[who]
    return (~low_on | (price >= low)) & (~high_on | (price <= high))     # nan fails


def _true_places(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero of few flags: eight are looked at together."""
    flat = flags.ravel()
    whole = len(flat) - len(flat) % 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    of, at = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[of] * 8 + at, np.flatnonzero(flat[whole:]) + whole])


def guessed_rank(k: int, share: float) -> int:
    """The k best of a table have fewer rows than this in a random share of it, but for bad luck."""
    mean = k * share
    return math.ceil(mean + 5 * math.sqrt(mean) + 6)


def best_rows(q: QueryBlock, c: CatalogBlock, k: int, digits: int | None, guess: bool = True):
    """(query number, row number, score) of each query's k best rows at or above its floor, by score and row number.

    Single precision finds the rows that can reach the bar, which is the floor less what
    rounding may take; these are scored in double precision. Without a floor the first piece sets the bar,
    for a large block by a guess. Queries that find fewer than k rows above a guess are searched again without.
    """
    n = len(c.rows)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not n or not len(q.vectors):
        return none
    slack = (c.rows.shape[1] + 8) * 2.0 ** -23 + (10.0 ** -digits if digits is not None else 0.0)
    floor = q.floor.copy()
    bar = floor - slack
    guessed = np.zeros(len(floor), bool)
    narrow = q.vectors.astype(np.float32)
    found, held = [none], 0
    space = np.empty(len(narrow) * min(n, PIECE_ROWS), np.float32)
    for start in range(0, n, PIECE_ROWS):
        piece = slice(start, min(n, start + PIECE_ROWS))
        width = piece.stop - start
        scores = np.matmul(narrow, c.narrow[piece].T, out=space[:len(narrow) * width].reshape(len(narrow), width))
        open_ended = np.flatnonzero(bar == -np.inf)
        rank = min(k, guessed_rank(k, width / (n - start))) if guess else k
        if len(open_ended) and width >= rank:
            seen = scores if len(open_ended) == len(scores) else scores[open_ended]
            allowed = _price_allowed(part_of(q, open_ended), c.price[piece])
            if allowed is not None:
                seen = np.where(allowed, seen, -np.inf)
            # The rank-th of the groups' best scores is no higher than the rank-th score.
            if width >= 4 * rank * GROUP_ROWS:
                seen = seen[:, :width - width % GROUP_ROWS].reshape(len(seen), -1, GROUP_ROWS).max(axis=2)
            seen = np.where(np.isnan(seen), -np.inf, seen)
            reached = np.partition(seen, -rank, axis=1)[:, -rank].astype(np.float64)
            bar[open_ended] = reached - 2 * slack
            guessed[open_ended] = (rank < k) & (reached > -np.inf)
        rows, cols = np.divmod(_true_places(scores >= bar.astype(np.float32)[:, None] - np.float32(1e-7)), width)
        allowed = _price_allowed(q, c.price[start + cols], rows)
        if allowed is not None:
            rows, cols = rows[allowed], cols[allowed]
        cols = cols + start
        values, part = np.empty(len(rows)), max(1, WIDE_AT_ONCE // c.rows.shape[1])
        for i in range(0, len(rows), part):
            some = slice(i, i + part)
            values[some] = np.einsum("ij,ij->i", q.vectors[rows[some]], c.vectors(cols[some]))
        if digits is not None:
            values = np.round(values, digits)
        kept = (values >= floor[rows]) & (values > -np.inf)
        found.append((rows[kept], cols[kept], values[kept] + 0.0))
        held += int(kept.sum())
        if held > 3 * k * len(floor) + PIECE_ROWS:
            found = [_first_k(found, k)]
            held = len(found[0][0])
            rows, _, values = found[0]
            place = np.arange(held) - np.searchsorted(rows, rows)
            full = place == k - 1
            floor[rows[full]] = np.maximum(floor[rows[full]], values[full])
            bar = np.maximum(bar, floor - slack)
    rows, cols, values = _first_k(found, k)
    short = np.flatnonzero(guessed & (np.bincount(rows, minlength=len(floor)) < k))
    if len(short):
        again, more_cols, more_values = best_rows(part_of(q, short), c, k, digits, guess=False)
        stays = ~np.isin(rows, short)
        parts = [(rows[stays], cols[stays], values[stays]), (short[again], more_cols, more_values)]
        rows, cols, values = _first_k(parts, k)
    return rows, cols, values


def _first_k(parts: list, k: int):
    """Hits ordered by query, score and row number, the first k of each query."""
    rows, cols, values = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept], values[kept]


def hits_in(q: QueryBlock, c: CatalogBlock, k: int, digits: int | None):
    """Tables of hits, some queries at a time; q_no is the query's number in the block."""
    step = max(1, CELLS_AT_ONCE // max(1, min(len(c.rows), PIECE_ROWS), 2 * k))
    for start in range(0, max(1, len(q.vectors)), step):
        rows, cols, values = best_rows(part_of(q, slice(start, start + step)), c, k, digits)
        hits = c.columns.take(pa.array(cols)).append_column("score", pa.array(values))
        yield hits.append_column("q_no", pa.array(rows + start, pa.int64()))


def score_block(q: QueryBlock, block: pa.Table, k: int, dim: int, digits: int | None,
                payload: list[str]) -> pa.Table:
    """Per query, the k best rows of one catalog block."""
    return pa.concat_tables(hits_in(q, catalog_block(block, dim, payload), k, digits))


def best_of_blocks(q: QueryBlock, blocks: list[CatalogBlock], k: int, digits: int | None):
    """(query number, `__at`, score) of each query's k best rows of all blocks, best first. What a block gave is the floor
    of the next. Of several blocks, rows that equal the k-th one in score stay too, as ids are not compared here."""
    found = None
    for block in blocks:
        rows, cols, values = best_rows(q, block, k, digits)
        at = block.columns.column("__at").to_numpy()[cols]
        if found is not None:
            rows, at, values = (np.concatenate(x) for x in zip(found, (rows, at, values)))
            order = np.lexsort((-values, rows))
            rows, at, values = cut_to(k, rows[order], at[order], values[order])
        found = rows, at, values
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == k - 1
        q.floor[rows[last]] = np.maximum(q.floor[rows[last]], values[last])
    return found


def cut_to(n: int, rows: np.ndarray, at: np.ndarray, values: np.ndarray):
    """The first n hits of each query, and those that equal the n-th one in score."""
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    last = np.arange(len(rows)) - place + n - 1
    kept = (place < n) | (values == values[np.minimum(last, len(rows) - 1)])
    return rows[kept], at[kept], values[kept]


def packed_best(batches, blocks: list[CatalogBlock], keys: list[str], off: tuple[float, float], k: int, dim: int, digits: int | None,
                schema: pa.Schema, first: int | None = None):
    """Feed a stream of queries, yield a row for each one that finds something: its keys, and as lists `__at` and score of its best
    rows of all blocks; with `first`, of these no more than that many and those that equal the last one in score.
    Where the schema has whole numbers for scores, which are rounded then, these count units of the last digit."""
    in_units = pa.types.is_integer(schema.types[-1].value_type)
    widest = max((min(len(c.rows), PIECE_ROWS) for c in blocks), default=1)
    step = max(1, CELLS_AT_ONCE // max(1, widest, 2 * k))
    for batch in batches:
        q = query_block(pa.Table.from_batches([batch]), keys, dim, off)
        for start in range(0, len(q.vectors), step):
            hits = best_of_blocks(part_of(q, slice(start, start + step)), blocks, k, digits)
            rows, at, values = hits if first is None else cut_to(first, *hits)
            if in_units:
                values = np.rint(values * 10.0 ** digits).astype(np.int32)
            who, begins = np.unique(rows, return_index=True)
            ends = pa.array(np.append(begins, len(rows)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at, values)]
            columns = [c.combine_chunks() for c in q.keys.take(pa.array(who + start)).columns]
            yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(columns + lists, schema.types)], schema=schema)


def keep_best(hits: pa.Table, q: QueryBlock, k: int) -> pa.Table:
    """The k best hits per query; raises the floors of the full queries."""
    hits = hits.combine_chunks().sort_by(
        [("q_no", "ascending"), ("score", "descending"), ("id", "ascending")]
    )
    q_no = hits.column("q_no").to_numpy()
    place = np.arange(len(q_no)) - np.searchsorted(q_no, q_no)
    hits = hits.filter(pa.array(place < k))
    last = place == k - 1
    scores = hits.column("score").to_numpy()
    q.floor[q_no[last]] = np.maximum(q.floor[q_no[last]], scores[(place[place < k]) == k - 1])
    return hits


def with_query_keys(hits: pa.Table, q: QueryBlock, columns: list[str]) -> pa.Table:
    keys = q.keys.take(hits.column("q_no"))
    for name in keys.column_names:
        hits = hits.append_column(name, keys.column(name))
    return hits.select(columns)


def best_of_stream(batches, q: QueryBlock, k: int, dim: int, digits, payload, columns):
    """Feed a stream of catalog batches, yield the partition's k best per query."""
    best, waiting, n_waiting = [], [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        hits = score_block(q, pa.Table.from_batches([batch]), k, dim, digits, payload)
        waiting.append(hits)
        n_waiting += hits.num_rows
        if n_waiting > k * len(q.vectors):
            best = [keep_best(pa.concat_tables(best + waiting), q, k)]
            waiting, n_waiting = [], 0
    parts = best + waiting
    if parts:  # a single part holds at most k rows per query already
        merged = parts[0] if len(parts) == 1 else keep_best(pa.concat_tables(parts), q, k)
        yield from with_query_keys(merged, q, columns).to_batches(max_chunksize=OUT_ROWS)


def best_of_cells(batches, q: QueryBlock, asked: np.ndarray, k: int, dim: int, digits, columns):
    """As best_of_stream, for rows with a column `cell`: asked[i, cell] tells whether query i wants that cell."""
    best, waiting, n_waiting = [], [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        cells = table.column("cell").to_numpy()
        for cell in np.unique(cells):
            who = np.flatnonzero(asked[:, cell])
            rows = table.filter(pa.array(cells == cell))
            hits = score_block(part_of(q, who), rows, k, dim, digits, [])
            hits = hits.set_column(hits.column_names.index("q_no"), "q_no", pa.array(who[hits.column("q_no").to_numpy()], pa.int64()))
            waiting.append(hits)
            n_waiting += hits.num_rows
            if n_waiting > k * len(q.vectors):
                best = [keep_best(pa.concat_tables(best + waiting), q, k)]
                waiting, n_waiting = [], 0
    if best or waiting:
        yield from with_query_keys(keep_best(pa.concat_tables(best + waiting), q, k), q, columns).to_batches(max_chunksize=OUT_ROWS)
