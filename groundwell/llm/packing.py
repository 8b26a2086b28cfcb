"""Packing documents into token sequences: first-fit decreasing with a tournament tree.

Each document is tokenised once and cut at every ``seq_len`` ids; its full
pieces are sequences of their own. Only lengths and checksums then move: the
remainders are dealt to randomised groups of bounded size, and each group is
packed by itself, the tree finding the first open bin with room in O(log n).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import cut

#: The definition of a tokenizer that lower-cases and drops white space, so that a text's ids are those of its words in a row.
WORD_WISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: A word that such a tokenizer splits into its letters, lower-cased, and its closing marks.
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?%*$&#|]*)$"
#: Parts of words that a worker remembers: about 20 MB.
REMEMBERED = 300_000
#: Characters of texts tokenised together, and of a long text taken at once.
AT_ONCE, CHUNK = 1 << 21, 1 << 20
#: Sequence ids of one group lie in a block of this size.
GROUP_SPAN = 1 << 40


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; ``sizes`` must not increase. The tree's leaves are bins, its nodes the most room below."""
    n = max(1, len(sizes))
    width = 1 << (n - 1).bit_length()
    room = [capacity] * (2 * width)
    bins = []
    for s in sizes:
        at = 1
        while at < width:
            at *= 2
            if room[at] < s:
                at += 1
        bins.append(at - width)
        room[at] -= s
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


def _chunks(text: str) -> Iterator[str]:
    """``text`` in parts of about ``CHUNK`` characters, cut only at spaces."""
    at = 0
    while len(text) - at > CHUNK and (cut_ := text.find(" ", at + CHUNK)) >= 0:
        yield text[at:cut_]
        at = cut_ + 1
    yield text[at:] if at else text


def gather(values, starts, lengths, codes):
    """The runs ``values[starts[c] : starts[c] + lengths[c]]`` of all codes in a row, and where each ends."""
    import numpy as np

    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.repeat((starts[codes] - (ends - n)).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return values[at], ends


def word_wise(definition: str) -> bool:
    """Whether words can be tokenised apart: the definition is as in ``WORD_WISE`` and no added token holds or strips white space."""
    told = json.loads(definition)
    plain = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in told["added_tokens"])
    return plain and all(told[k] == v for k, v in WORD_WISE.items())


class TextIds:
    """Texts to ids, each text tokenised whole: right for any tokenizer."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def encode(self, texts: Iterable[str | None], end_id: int) -> Iterator[bytes]:
        """The packed ids of each text, with ``end_id`` last."""
        import numpy as np

        # one at a time: what the library keeps beside the ids of a text is many times the text
        for t in texts:
            yield np.asarray([*self.tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], "<u4").tobytes()


class WordIds:
    """Texts to ids for a tokenizer that is ``word_wise``: a text's ids are its words' in a row.

    Texts are taken by the handful. Their words are numbered, each different
    word is cut into letters and closing marks, and each different part is
    tokenised once; the rest is array arithmetic. Parts are tokenised together,
    parted by a mark that is one token of its own, since a call for each would
    cost several times the tokenising. Up to ``REMEMBERED`` parts are kept for
    the next handfuls; when there are more, only the last handful's are.
    """

    #: Symbols to try as the mark.
    MARKS = "\u2665\u2605\u2022\u2122\u00ae\u25cf\u2192\u2713\u266a\u00a9"

    def __init__(self, tokenizer) -> None:
        import numpy as np
        import pyarrow as pa

        self.tokenizer = tokenizer
        self.parts, self.ids, none = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.starts, self.lengths = none, none
        found = ((m, tokenizer.encode(m, add_special_tokens=False).ids) for m in self.MARKS)
        self.sign, self.mark = next(((m, ids[0]) for m, ids in found if len(ids) == 1), ("", -1))

    def _ids(self, texts: list[str]):
        """The ids of the texts in a row, parted by the mark's."""
        import numpy as np

        out = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            out += e.ids
            out.append(self.mark)
        return np.asarray(out[:-1], "<u4")

    def tokenised(self, parts: list[str]):
        """The ids of all parts, and each part's start and number of ids."""
        import numpy as np

        apart = [i for i, x in enumerate(parts) if not self.sign or self.sign in x]
        plain = [i for i, x in enumerate(parts) if self.sign and self.sign not in x]
        starts, lengths, ids, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), [], 0
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            made = self._ids([f" {self.sign} ".join(parts[i] for i in some[k : k + 50]) for k in range(0, len(some), 50)])
            ends = np.append(np.flatnonzero(made == self.mark), len(made))
            if len(ends) != len(some):  # some part yields the mark itself
                apart += some
                continue
            begins = np.append(0, ends[:-1] + 1)
            starts[some], lengths[some] = size + begins, ends - begins
            ids.append(made)
            size += len(made)
        for i in apart:
            made = np.asarray(self.tokenizer.encode(parts[i], add_special_tokens=False).ids, "<u4")
            starts[i], lengths[i] = size, len(made)
            ids.append(made)
            size += len(made)
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), starts, lengths

    def looked_up(self, parts):
        """The ids of all different ``parts`` known or not, and each part's start and number of ids."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(parts, self.parts)
        new = at.is_null()
        fresh = parts.filter(new)
        ids, starts, lengths = self.tokenised(fresh.to_pylist())
        where = np.array(at.fill_null(0), np.int64)
        where[new.to_numpy(zero_copy_only=False)] = len(self.parts) + np.arange(len(fresh))
        self.ids, self.starts, self.lengths = np.append(self.ids, ids), np.append(self.starts, starts + len(self.ids)), np.append(self.lengths, lengths)
        self.parts = pa.concat_arrays([self.parts, fresh])
        starts, lengths = self.starts[where], self.lengths[where]
        if len(self.parts) > REMEMBERED:
            self.ids, ends = gather(self.ids, starts, lengths, np.arange(len(parts)))
            starts = ends - lengths
            self.parts, self.starts, self.lengths = parts, starts, lengths
        return self.ids, starts, lengths

    def _handful(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = words.flatten().dictionary_encode()
        different = numbered.dictionary
        cut_up = pc.extract_regex(different, PLAIN)
        stems = pc.if_else(cut_up.is_valid(), pc.utf8_lower(pc.struct_field(cut_up, "stem")), different)
        marks = pc.if_else(cut_up.is_valid(), pc.struct_field(cut_up, "marks"), "")
        parts = pa.concat_arrays([stems, marks.cast(stems.type)]).dictionary_encode()
        ids, starts, lengths = self.looked_up(parts.dictionary)
        # the parts of each different word, then the words of each text
        pairs = np.asarray(parts.indices).reshape(2, -1).T.ravel()
        ids, ends = gather(ids, starts, lengths, pairs)
        ends = ends[1::2]
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        ids, ends = gather(ids, starts, ends - starts, np.asarray(numbered.indices))
        last = np.cumsum(np.asarray(pc.list_value_length(words)))
        ends = np.append(0, ends)[last]
        packed, out, at = ids.tobytes(), [], 0
        for end in (4 * ends).tolist():
            out.append(packed[at:end])
            at = end
        return out

    def encode(self, texts: Iterable[str | None], end_id: int) -> Iterator[bytes]:
        """The packed ids of each text, with ``end_id`` last; no more texts than a handful are held."""
        end = end_id.to_bytes(4, "little")
        docs: list[list[bytes]] = []
        held: list[str] = []
        owners: list[list[bytes]] = []
        size = 0

        def work() -> None:
            for mine, ids in zip(owners, self._handful(held) if held else ()):
                mine.append(ids)

        for t in texts:
            mine: list[bytes] = []
            docs.append(mine)
            for part in _chunks(t or ""):
                if held and size + len(part) > AT_ONCE:
                    work()
                    held, owners, size = [], [], 0
                    for x in docs[:-1]:
                        yield b"".join([*x, end])
                    docs = [mine]
                held.append(part)
                owners.append(mine)
                size += len(part)
        work()
        for x in docs:
            yield b"".join([*x, end])


_AT_WORK: dict[str, WordIds | TextIds] = {}


def encoder(tokenizer_path: str) -> WordIds | TextIds:
    """This worker process's encoder for a tokenizer, kept from task to task.

    The ids are those of ``Tokenizer.encode`` as loaded: the strings of its
    added tokens, where a text holds them, give those tokens.
    """
    if tokenizer_path not in _AT_WORK:
        # a task has one core; the library's own threads would take those of other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        _AT_WORK[tokenizer_path] = (WordIds if word_wise(tokenizer.to_str()) else TextIds)(tokenizer)
    return _AT_WORK[tokenizer_path]


def pieces(df: DataFrame, text: str, id_col: str, tokenizer_path: str, seq_len: int, end_id: int) -> DataFrame:
    """(id, tokens, crcs): each document's ids counted, with the CRC-32 of each piece of ``seq_len`` and of the rest."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        known = encoder(tokenizer_path)
        step = 4 * seq_len
        for batch in batches:
            counts, crcs = [], []
            for ids in known.encode((x.as_py() for x in batch.column(1)), end_id):
                counts.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["id", "tokens", "crcs"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, tokens long, crcs array<long>")


def pack(
    df: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", seq_len: int = 2048, end_id: int = 1, group_docs: int = 4096, seed: int = 11
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are its tokens and ``end_id``, so a null or empty text is a
    piece of one id. Every id lies in exactly one piece. Repeated rows and ids
    are packed as documents of their own; an empty table gives no rows; other
    columns are not read. Groups hold about ``group_docs`` documents whatever
    the table's size, dealt by a seeded hash of id and content.
    """
    import pandas as pd

    docs = cut(pieces(df, text, id_col, tokenizer_path, seq_len, end_id))
    kind = dict(docs.dtypes)["id"]
    groups = max(1, -(-docs.count() // group_docs))
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("id", "tokens", "crcs", F.lit(seed)), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.assign(rest=pdf["tokens"] % seq_len, first=pdf["crcs"].map(lambda c: c[-1])).sort_values(["rest", "id", "first"], ascending=[False, True, True], kind="stable")
        tokens, rest = pdf["tokens"].to_numpy(), pdf["rest"].to_numpy()
        full = tokens // seq_len
        part = rest > 0
        bins = np.asarray(first_fit_decreasing(rest[part].tolist(), seq_len), np.int64)
        n_bins = int(bins.max()) + 1 if len(bins) else 0
        order = np.argsort(bins, kind="stable")
        sized = rest[part][order]
        ends = np.cumsum(sized)
        opens = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(bins) else np.zeros(0, bool)
        offsets = (ends - sized) - np.repeat((ends - sized)[opens], np.diff(np.r_[np.flatnonzero(opens), len(bins)])) if len(bins) else ends
        base = int(key[0]) * GROUP_SPAN
        rests = pdf[part].iloc[order]
        a = pd.DataFrame({"id": rests["id"], "start": rests["tokens"] - rests["rest"], "length": rests["rest"], "ids_crc32": rests["first"], "doc_tokens": rests["tokens"], "sequence_id": base + bins[order], "offset": offsets})
        wide = np.repeat(np.arange(len(pdf)), full)
        nth = np.arange(len(wide)) - np.repeat(np.cumsum(full) - full, full)
        crcs = pdf["crcs"].to_numpy()
        b = pd.DataFrame(
            {"id": pdf["id"].iloc[wide], "start": nth * seq_len, "length": seq_len, "ids_crc32": [crcs[i][k] for i, k in zip(wide, nth)], "doc_tokens": tokens[wide], "sequence_id": base + n_bins + np.arange(len(wide)), "offset": 0}
        )
        return pd.concat([a, b], ignore_index=True).astype({c: "int64" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")})

    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("g").applyInPandas(run, out).withColumnRenamed("id", id_col)
