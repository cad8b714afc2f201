"""Compressed sizes of texts under raw-content zstandard dictionaries."""

from __future__ import annotations

import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A text is compressed in blocks of so many bytes, so that the dictionary matters all along a long text.
BLOCK_BYTES = 2048


def hashed_slice(text: Column, chars: int, seed: int) -> Column:
    """``chars`` consecutive characters of a text from a place that its hash chooses; a shorter text as a whole."""
    places = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(F.lit(seed), text), places) + 1).cast("int"), F.lit(chars))


def make_dictionary(slices: list[bytes], size: int) -> bytes:
    """Raw content for a dictionary: slices of texts, of each at most an equal share of ``size`` bytes."""
    share = max(1, size // max(1, len(slices)) - 1)
    return b"\n".join(d[:share] for d in slices)[:size]


class Sizer:
    """Total compressed size of a text under each of several dictionaries."""

    def __init__(self, dictionaries: list[bytes]):
        self.compress = []
        # Matches of three bytes on: syllables and separators tell texts apart, not only whole words.
        how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=15, search_log=3, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        for content in dictionaries:
            d = zstandard.ZstdCompressionDict(content or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def sizes(self, data: bytes) -> list[int]:
        """Sums over all blocks of the whole data; zeros for no data."""
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(f(b)) for b in blocks) for f in self.compress]
