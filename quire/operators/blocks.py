"""Posting lists in blocks: of each word the pages and places that hold it, coded by their differences.

A block is a row: word, first and last page, position of the first page's first token, numbers
of pages and places, and one binary of variable-length integers: for each page its distance to
the page before, that of its first token's position, and its count of the word; then all places,
each less the one before in its page. Blocks are made from slices of pages, so no row a token is ever shuffled, and
hold whole pages with up to BLOCK places (one page at least). First and last page let
readers skip blocks.

Most words are rare and have a short block in every slice. On the way to a saved index the short
blocks of a slice travel as groups, one row for all words between two bounds, and are joined
to one block a word where the groups of all slices meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from quire.functions.text import text_words

#: Places of a block, about.
BLOCK = 4096
#: Tokens whose lists are made at once, about.
SLICE = 1_000_000
#: Places of blocks that a reader unpacks at once, about.
HELD = 250_000
SCHEMA = "word string, first_page long, last_page long, start long, n_pages int, n int, data binary"
FIELDS = ["word", "first_page", "last_page", "start", "n_pages", "n", "data"]
#: Columns of rows that are blocks, or groups of a slice's blocks of less than FULL places: word is the lower bound of their words then,
#: first_page and start are the least, n_pages counts blocks; words: one a line; heads: of each block its numbers of pages and places, and how far its first page and start lie behind the row's.
GROUPED, FULL = [*FIELDS, "words", "heads"], 512
#: Positions of a bitmap of Spark's bitmap functions, and bitmaps that a task holds at once.
BITS, BITMAPS = 1 << 15, 512
#: Ranges of pages that a reader asks for at most; nearer ones are merged.
RANGES = 64


def coded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each number): seven bits a byte, the lowest first; the last byte's high bit is unset."""
    size, first = np.ones(len(numbers), np.int8), numbers.astype(np.uint8)
    large = np.flatnonzero(numbers > 127)  # few; the others are their bytes
    if not len(large):
        return first, size
    first[large] |= 128
    at, left = large, numbers[large] >> 7
    while len(at):
        size[at] += 1
        stay = left > 127
        at, left = at[stay], left[stay] >> 7
    more = size[large].astype(np.int64) - 1
    out = np.zeros(len(numbers) + int(more.sum()), np.uint8)
    plain = np.ones(len(out), bool)
    at, left, behind = large + _heads(more), numbers[large] >> 7, 1
    while len(at):
        stay = left > 127
        plain[at + behind] = False
        out[at + behind] = (left & 127 | stay << 7).astype(np.uint8)
        at, left, behind = at[stay], left[stay] >> 7, behind + 1
    out[plain] = first
    return out, size


def decoded_numbers(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    size = np.diff(last, prepend=-1)
    out = data[last].astype(np.int64)
    at, behind = np.flatnonzero(size > 1), 1  # most numbers are one byte
    while len(at):
        out[at] = out[at] << 7 | (data[last[at] - behind] & 127)
        behind += 1
        at = at[size[at] > behind]
    return out


def _differences(values: np.ndarray, heads: np.ndarray, whole: bool) -> np.ndarray:
    """Each value less the one before; at heads the value itself, or 0 if not whole."""
    out = np.diff(values, prepend=0)
    out[heads] = values[heads] if whole else 0
    return out


def _running(values: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums from each head on."""
    total = np.cumsum(values)
    return total - np.repeat(total[heads] - values[heads], sizes)


def _heads(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _blocks_of(names: pa.Array, word: np.ndarray, page: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray, block: int) -> pa.RecordBatch:
    """Blocks of words in pages, in the order of word (an index of names) and page; place: those of each word in a page, one after another."""
    head = _heads(count)
    first_of_word = np.flatnonzero(np.concatenate([[True], np.diff(word) != 0]))
    before = head - np.repeat(head[first_of_word], np.diff(np.append(first_of_word, len(head))))
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(word) != 0) | (np.diff(before // block) != 0)]))  # first page of each block
    n_pages = np.diff(np.append(cut, len(head)))
    n = np.add.reduceat(count, cut)
    total = 3 * n_pages + n
    base, inside = _heads(total), np.arange(len(head)) - np.repeat(cut, n_pages)
    numbers = np.zeros(int(total.sum()), np.int64)
    at = np.repeat(base, n_pages) + inside
    width = np.repeat(n_pages, n_pages)
    numbers[at] = _differences(page, cut, False)
    numbers[at + width] = _differences(start, cut, False)
    numbers[at + 2 * width] = count
    numbers[np.repeat(base + 3 * n_pages, n) + np.arange(len(place)) - np.repeat(_heads(n), n)] = _differences(place, head, True)
    data, size = coded(numbers)
    ends = np.cumsum(np.add.reduceat(size, base, dtype=np.int64))
    binary = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
    columns = [names.take(pa.array(word[cut])), pa.array(page[cut]), pa.array(page[cut + n_pages - 1]), pa.array(start[cut]), pa.array(n_pages.astype(np.int32)), pa.array(n.astype(np.int32)), binary]
    return pa.RecordBatch.from_arrays(columns, FIELDS)


def slice_blocks(pages: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tokens: pa.Array, block: int = BLOCK) -> pa.RecordBatch | None:
    """The blocks of some pages in order: their numbers, positions of their first tokens, numbers of tokens, and all tokens."""
    if not len(tokens):
        return None
    encoded = tokens.dictionary_encode()
    word = encoded.indices.to_numpy()
    by_word = np.sort((word.astype(np.int64) << 32) | np.arange(len(word)))  # by word, then place
    word, order = by_word >> 32, by_word & 0xFFFFFFFF
    page_at = np.repeat(np.arange(len(pages)), sizes)[order]
    place = (np.arange(len(order)) - np.repeat(_heads(sizes), sizes))[order]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(word) != 0) | (np.diff(page_at) != 0)]))  # a word in a page
    return _blocks_of(encoded.dictionary, word[head], pages[page_at[head]], starts[page_at[head]], np.diff(np.append(head, len(word))), place, block)


def _grouped(found: pa.RecordBatch, bounds: pa.Array, full: int = FULL) -> pa.RecordBatch:
    """GROUPED of a slice's blocks; bounds: words in order that part the words."""
    short = found.column("n").to_numpy() < full
    long, rest = found.filter(pa.array(~short)), found.filter(pa.array(short))
    columns = [*long.columns, pa.nulls(long.num_rows, pa.string()), pa.nulls(long.num_rows, pa.binary())]
    if not rest.num_rows:
        return pa.RecordBatch.from_arrays(columns, GROUPED)
    order = pc.sort_indices(pa.concat_arrays([bounds, rest.column("word")])).to_numpy().astype(np.int64)
    bound = order < len(bounds)  # before the words that equal it
    rest = rest.take(pa.array(order[~bound] - len(bounds)))
    group = np.cumsum(bound)[~bound]
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    n_pages, n, first, start = (rest.column(c).to_numpy().astype(np.int64) for c in ("n_pages", "n", "first_page", "start"))
    heads, size = coded(np.stack([n_pages, n, first - first.min(), start - start.min()], 1).ravel())
    data = pa.concat_arrays([rest.column("data")])
    ends, offsets = np.append(0, np.cumsum(size)), np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    binaries = [pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(o.astype(np.int32).tobytes()), b]) for o, b in ((offsets[cuts], data.buffers()[2]), (ends[4 * cuts], pa.py_buffer(heads.tobytes())))]
    keys = pa.concat_arrays([pa.array([""]), bounds]).take(pa.array(group[cuts[:-1]]))
    each = lambda value: pa.array(np.full(len(cuts) - 1, value, np.int64))
    sizes = [pa.array(a.astype(np.int32)) for a in (np.diff(cuts), np.add.reduceat(n, cuts[:-1]))]
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest.column("word")), "\n")
    grouped = [keys, each(first.min()), each(rest.column("last_page").to_numpy().max()), each(start.min()), *sizes, binaries[0], words, binaries[1]]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(columns, grouped)], GROUPED)


def joined_groups(rows: DataFrame, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """SCHEMA of rows (GROUPED) that lie by word and first page: of each word in groups one block, or one for each ``size`` places of its group.

    Blocks that came alone stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, key = [], 0, None

        def out() -> pa.RecordBatch:
            firsts, starts, blocks, words, heads, data = zip(*held)
            names = pc.split_pattern(pa.array(["\n".join(words)]), "\n").flatten().dictionary_encode()
            n_pages, sizes, first, start = decoded_numbers(np.frombuffer(b"".join(heads), np.uint8)).reshape(-1, 4).T
            first, start = first + np.repeat(firsts, blocks), start + np.repeat(starts, blocks)
            page, start, count, place = _pages_of(n_pages, sizes, first, start, b"".join(data))
            by_name = pc.sort_indices(names.dictionary)
            word = np.argsort(by_name.to_numpy())[names.indices.to_numpy()]
            order = np.lexsort((first, word))
            own, _ = _gathered(order, n_pages)
            places, counts = _gathered(own, count)
            return _blocks_of(names.dictionary.take(by_name), np.repeat(word[order], n_pages[order]), page[own], start[own], counts, place[places], block)

        for batch in batches:
            alone = pc.is_null(batch.column("heads"))
            yield batch.filter(alone).select(FIELDS)
            groups = batch.filter(pc.invert(alone))
            columns = (groups.column(c).to_pylist() for c in ("word", "n", "first_page", "start", "n_pages", "words", "heads", "data"))
            for word, places, *group in zip(*columns):
                if held and n >= (size if word == key else size // 4):
                    yield out()
                    held, n = [], 0
                held.append(group)
                n, key = n + places, word
        if held:
            yield out()

    return rows.select(*GROUPED).mapInArrow(run, SCHEMA)


def _gathered(order: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the items lie, sizes) of runs of items, of sizes, in another order."""
    found = sizes[order]
    return np.repeat(_heads(sizes)[order] - _heads(found), found) + np.arange(found.sum()), found


def moved_blocks(blocks: DataFrame, moves: DataFrame, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """SCHEMA of blocks, with pages numbered anew: moves (page_idx, new_page, new_start) says the pages that stay and where; no text is read.

    A row for each word in a page goes to the range of its new page, and is coded again there.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            n_pages, page, _, count, place = _unpacked(batch)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(place))
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(np.repeat(np.arange(batch.num_rows), n_pages))), pa.array(page), lists], ["word", "page_idx", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            encoded = table.column("word").combine_chunks().dictionary_encode()
            word, page = encoded.indices.to_numpy(), table.column("new_page").to_numpy()
            order = np.lexsort((page, word))
            lists = table.column("places").combine_chunks().take(pa.array(order))
            return _blocks_of(encoded.dictionary, word[order], page[order], table.column("new_start").to_numpy()[order], np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), block)

        for batch in batches:
            if n >= size and batch.num_rows and held:  # a page's words stay together
                last = held[-1].column("new_page")[-1].as_py()
                same = int((batch.column("new_page").to_numpy() == last).sum())
                if same:
                    held.append(batch.slice(0, same))
                yield out()
                held, n, batch = [], 0, batch.slice(same)
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column("places").flatten())
        if held:
            yield out()

    rows = _few_rows(blocks).mapInArrow(unpacked, "word string, page_idx long, places array<long>").join(moves, "page_idx").select("word", "new_page", "new_start", "places")
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "new_page").sortWithinPartitions("new_page").mapInArrow(run, SCHEMA)


def posting_blocks(pages: DataFrame, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """SCHEMA from pages (page_idx, sidx_start, tokens); best in the order of pages, as index.tokenised() writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            table = pa.Table.from_batches(held).sort_by("page_idx")
            lists = table.column("tokens").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            return slice_blocks(table.column("page_idx").to_numpy(), table.column("sidx_start").to_numpy(), sizes, lists.flatten(), block)

        for batch in batches:
            lengths = np.diff(batch.column("tokens").offsets.to_numpy())
            cuts = np.flatnonzero(np.diff((n + np.cumsum(lengths)) // size)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                held.append(batch.slice(a, b - a))
                n += int(lengths[a:b].sum())
                if n >= size:
                    if (found := out()) is not None:
                        yield found
                    held, n = [], 0
        if held and (found := out()) is not None:
            yield found

    return pages.select("page_idx", "sidx_start", "tokens").mapInArrow(run, SCHEMA)


def text_blocks(rows: DataFrame, texts: bool, bounds: list[str] | None, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """Rows of pages and rows of their posting blocks from pages (doc_name, page_key, text) that lie in their order in each part.

    Those of pages have no word, but their part, document, document's first row, row, tokens
    and tokens ahead in it, and the text if asked for; those of blocks count pages and
    positions in the part. So a text goes through Python once, and its words are nowhere
    written but in the blocks. bounds: words in order that part the words of groups; with them
    those of blocks are GROUPED.
    """
    names = ["doc_name", "page_key", *(["text"] if texts else [])]
    own = [rows.schema[name] for name in names]
    counted = ["_doc", "_doc_row", "_row", "n_tokens", "_sum"]
    longs = [StructField(name, LongType()) for name in counted]
    listed = [StructField(name, kind) for name, kind in zip(FIELDS, (StringType(), LongType(), LongType(), LongType(), IntegerType(), IntegerType(), BinaryType()))]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    if bounds is not None:
        listed += [StructField("words", StringType()), StructField("heads", BinaryType())]
        kinds += [pa.string(), pa.binary()]
    schema = StructType([*(StructField(f.name, f.dataType) for f in own), *longs, *listed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, doc, doc_row, ahead, last, first = 0, 0, 0, 0, None, True
        held, n, types = [], 0, None

        def out() -> Iterator[pa.RecordBatch]:
            pages, starts, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
            found = slice_blocks(pages, starts, sizes, pa.concat_arrays([h[3] for h in held]), block)
            if found is not None:
                found = found if bounds is None else _grouped(found, pa.array(bounds, pa.string()))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(found.num_rows, t) for t in types), *found.columns], schema.names)

        for batch in batches:
            types = [*(batch.column(name).type for name in names), *[pa.int64()] * len(counted)]
            for part in _pieces(batch, size):
                tokens, sizes = text_words(part.column("text"))
                docs, starts = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for i, name in enumerate(part.column("doc_name").to_pylist()):
                    if not first and name != last:
                        doc, doc_row = doc + 1, row + i
                    first, last, docs[i], starts[i] = False, name, doc, doc_row
                pages, sums = np.arange(row, row + part.num_rows), ahead + np.cumsum(sizes) - sizes
                row, ahead, n = row + part.num_rows, ahead + len(tokens), n + len(tokens)
                numbers = [pa.array(a, pa.int64()) for a in (docs, starts, pages, sizes, sums)]
                yield pa.RecordBatch.from_arrays([*(part.column(name) for name in names), *numbers, *(pa.nulls(part.num_rows, t) for t in kinds)], schema.names)
                held.append((pages, sums, sizes, tokens))
                if n >= size:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    return rows.select("doc_name", "page_key", "text").mapInArrow(run, schema).withColumn("_part", F.spark_partition_id())


def _pieces(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about 4 * size bytes of text, and one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(lengths) // (4 * size))) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(pages of each block, page, start, count, place) of a batch's blocks; place: of each token, the others: of each page of a block."""
    n_pages, n, first, start = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_pages", "n", "first_page", "start"))
    return n_pages, *_pages_of(n_pages, n, first, start, b"".join(batch.column("data").to_pylist()))


def _pages_of(n_pages: np.ndarray, n: np.ndarray, first: np.ndarray, first_start: np.ndarray, data: bytes) -> tuple[np.ndarray, ...]:
    """(page, start, count, place) of blocks whose data follow one another."""
    numbers = decoded_numbers(np.frombuffer(data, np.uint8))
    base, cut = _heads(3 * n_pages + n), _heads(n_pages)
    at = np.repeat(base, n_pages) + np.arange(n_pages.sum()) - np.repeat(cut, n_pages)
    width = np.repeat(n_pages, n_pages)
    page = _running(numbers[at], cut, n_pages) + np.repeat(first, n_pages)
    start, count = _running(numbers[at + width], cut, n_pages) + np.repeat(first_start, n_pages), numbers[at + 2 * width]
    own = np.repeat(base + 3 * n_pages, n) + np.arange(n.sum()) - np.repeat(_heads(n), n)
    return page, start, count, _running(numbers[own], _heads(count), count)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of HELD places and one block at most, none of them empty: full blocks hold thousands of places each."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
        cuts = (np.flatnonzero(np.diff(ends // HELD)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def word_places(blocks: DataFrame) -> DataFrame:
    """(word, page_idx, pos, sidx): one row a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            n_pages, page, start, count, place = _unpacked(batch)
            each = np.repeat(np.repeat(np.arange(batch.num_rows), n_pages), count)
            columns = [batch.column("word").take(pa.array(each)), pa.array(np.repeat(page, count)), pa.array(place.astype(np.int32)), pa.array(np.repeat(start, count) + place)]
            for at in range(0, len(each), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in columns], ["word", "page_idx", "pos", "sidx"])

    return _few_rows(blocks).mapInArrow(run, "word string, page_idx long, pos int, sidx long")


def word_pages(blocks: DataFrame) -> DataFrame:
    """(word, page_idx, n): one row for a word in a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            n_pages, page, _, count, _ = _unpacked(batch)
            columns = [batch.column("word").take(pa.array(np.repeat(np.arange(batch.num_rows), n_pages))), pa.array(page), pa.array(count)]
            for at in range(0, len(page), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in columns], ["word", "page_idx", "n"])

    return _few_rows(blocks).mapInArrow(run, "word string, page_idx long, n long")


def page_lists(blocks: DataFrame, column: str = "sidx") -> DataFrame:
    """(word, page_idx, sidx array<long>): the positions of a word in a page, in order; or, of column pos, their places in the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            n_pages, page, start, count, place = _unpacked(batch)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(np.repeat(start, count) + place if column == "sidx" else place))
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(np.repeat(np.arange(batch.num_rows), n_pages))), pa.array(page), lists], ["word", "page_idx", column])

    return _few_rows(blocks).mapInArrow(run, f"word string, page_idx long, {column} array<long>")


def position_bits(rows: DataFrame, held: int = BITMAPS) -> DataFrame:
    """(bucket, n, last, bits): how many positions a range of BITS holds, the last, and a bit for each; of blocks, or rows (sidx).

    A task hands on a row for each range that it holds, or some if its positions lie in no
    order, so a bit a token is shuffled at most, not a row.
    """
    packed = "data" in rows.columns

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in _bounded(batches) if packed else batches:
            if packed:
                _, _, start, count, place = _unpacked(batch)
                yield np.repeat(start, count) + place
            else:
                yield batch.column(0).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            n, last, bits = zip(*found.values())
            columns = [pa.array(found.keys(), pa.int64()), pa.array(n, pa.int64()), pa.array(last, pa.int64()), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "n", "last", "bits"])

        for places in positions(batches):
            places = np.sort(places)
            cuts = np.flatnonzero(np.diff(places // BITS)) + 1
            for part in np.split(places, cuts) if len(places) else []:
                bucket = int(part[0]) // BITS
                if bucket not in found and len(found) == held:
                    yield out()
                    found.clear()
                one = found.setdefault(bucket, [0, 0, np.zeros(BITS, bool)])
                one[0], one[1] = one[0] + len(part), max(one[1], int(part[-1]))
                one[2][part - bucket * BITS] = True
        if found:
            yield out()

    return (_few_rows(rows) if packed else rows.select(F.col("sidx").cast("long"))).mapInArrow(run, "bucket long, n long, last long, bits binary")


def _few_rows(blocks: DataFrame) -> DataFrame:
    """What is needed of blocks, in the order that the readers expect."""
    return blocks.select("word", "first_page", "start", "n_pages", "n", "data")


def page_ranges(pages: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all pages, cut at the widest gaps."""
    found = np.unique(np.array(pages, np.int64))
    if not len(found):
        return []
    gaps = np.diff(found)
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: most - 1]) if len(gaps) else np.zeros(0, int)
    cuts = cuts[gaps[cuts] > 1]
    return list(zip(found[np.append(0, cuts + 1)].tolist(), found[np.append(cuts, len(found) - 1)].tolist()))


def in_ranges(ranges: list[tuple[int, int]]) -> Column:
    """Whether a block may hold a page of the ranges; plain comparisons, which reach the scan."""
    found = [(F.col("last_page") >= a) & (F.col("first_page") <= b) for a, b in ranges]
    while len(found) > 1:  # a flat tree of ors
        found = [found[i] | found[i + 1] if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0] if found else F.lit(False)
