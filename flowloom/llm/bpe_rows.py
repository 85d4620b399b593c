"""Byte-level BPE with DataFrame functions alone: the named form of the fold, inside each row.

The words of a text are found by the tokenizer's pattern; each distinct word of the text is an array of hexadecimal bytes into which ranked merges are folded
by aggregate(); the ranks are literals: an array of maps by a hash of the merged bytes, as looking a key up in a map of 50,000 takes
as many steps. Nothing is shuffled and no Python runs. It gives the ids of bpe.encode at many times the cost (see the README), so op3 runs the Arrow form;
this one is for short texts where no Python worker is to be had.

Null and empty texts have no ids; equal rows get equal ids; very long texts cost the product of their words and distinct words; an
empty table gives no rows; other columns stay, one called `ids` is replaced.
"""

from __future__ import annotations

import json
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.bpe import load_ranks

#: Maps that the ranks are dealt into.
MAPS = 4096


def rank_maps(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of MAPS maps from hexadecimal bytes, by crc32 of that text."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        maps[crc32(key.encode()) % MAPS][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_in_row(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs(text, ...) with `ids`, an array of token ids."""
    maps = rank_maps(load_ranks(ranks_path))
    rank = lambda h: F.try_element_at(F.get(maps, F.pmod(F.crc32(h.cast("binary")), F.lit(MAPS)).cast("int")), h)
    let = lambda v, use: F.get(F.transform(F.array(v), use), F.lit(0))

    def merged(parts, _):
        def with_ranks(found):
            at = F.array_position(found, F.array_min(found)).cast("int")
            new = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))))
            return F.when(F.array_min(found).isNull(), parts).otherwise(new)

        pairs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda q, i: rank(F.concat(F.get(parts, i), q)))
        return F.when(F.size(parts) < 2, parts).otherwise(let(pairs, with_ranks))

    def word_ids(word):
        hexed = F.hex(F.encode(word, "UTF-8"))
        whole = F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))
        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(whole) - 1, F.lit(1))), whole, merged)
        return F.coalesce(F.when(rank(hexed).isNotNull(), F.array(rank(hexed))), F.transform(folded, rank))

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    table = lambda all_, some: let(F.map_from_arrays(some, F.transform(some, word_ids)), lambda m: F.flatten(F.transform(all_, lambda w: F.element_at(m, w))))
    return docs.drop("ids").withColumn("ids", let(words, lambda ws: table(ws, F.array_distinct(ws))))
