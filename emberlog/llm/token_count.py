"""Token counts of a byte-level BPE, by a map-side two-tier lookup.

Tier one is a broadcast table of the token lengths of frequent pre-tokens: the most frequent ones of a bounded
random sample of texts. Tier two is a cache in each Python worker, filled by encoding the pre-tokens that tier one
misses; it outlives the task where Spark keeps its worker. All texts are read once, no pre-token is shuffled, and
what the sample holds changes no count.
"""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, in_batches, slices, text_buffer

FREQUENT = 100_000  # entries of the broadcast table, under 5 MB
CACHE = 500_000  # entries of a worker's cache, the frequent ones among them
SAMPLE = 4_000  # texts of the sample, about; it is counted by PARTS tasks, each of which tells FREQUENT pre-tokens at most
PARTS = 4

#: how a byte-level BPE splits a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters that every version of Unicode classes alike; other texts are split by the library
PLAIN = r"[\t\n\x0b\f\r\x20-\x7e\xa0-ſ‐-‟…]*+"
_workers: dict = {}  # the encoder outlives a task where Spark reuses its worker


class Encoder:
    """The tokenizer, its regular expressions and the cache of one worker."""

    def __init__(self, spec: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.plain_pieces = regex.compile(PATTERN).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.frequent, self.cache = frequent, dict(frequent)

    def split(self, text: str) -> list[str]:
        if self.plain(text):
            return self.plain_pieces(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self, texts: list[str | None]) -> list[int]:
        out, pieces, hard = [0] * len(texts), {}, []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.special):
                hard.append(i)
            else:
                pieces[i] = self.split(text)
        missed = list({p for x in pieces.values() for p in x if p not in self.cache})
        if len(self.cache) + len(missed) > CACHE:
            self.cache = dict(self.frequent)
            missed = list({p for x in pieces.values() for p in x if p not in self.cache})
        self.cache.update(zip(missed, self.whole(missed), strict=True))
        of = self.cache.__getitem__
        for i, x in pieces.items():
            out[i] = sum(map(of, x))
        for i in hard:
            out[i] = self.whole([texts[i]])[0]
        return out


def _frequent(docs: DataFrame, spec: str, sample: int) -> list[str]:
    rows = docs.count()
    if not rows:
        return []

    def count(batches):
        split, seen = Encoder(spec, {}).split, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(p for p in split(text or "") if len(p) <= 64)
                if len(seen) > 4 * FREQUENT:
                    seen = Counter(dict(seen.most_common(FREQUENT)))
        keys, sums = zip(*seen.most_common(FREQUENT), strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.int64())], ["piece", "n"])

    some = in_batches(docs).select("text").sample(min(1.0, sample / rows), seed=31).repartition(PARTS)
    told = some.mapInArrow(count, "piece string, n long").toArrow()
    total: Counter = Counter()
    for piece, n in zip(told.column("piece").to_pylist(), told.column("n").to_pylist(), strict=True):
        total[piece] += n
    return [p for p, n in total.most_common(FREQUENT) if n > 1]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    tokenizer: path of a byte-level BPE for the library tokenizers, read on the driver.
    Null or empty text: 0 bytes, 0 tokens. Repeated rows each give a row, null
    doc_id stays null, no rows give no rows; other columns play no part. A text of any length is counted
    whole. A text with a special token's string is encoded whole by the library, which cuts it there first.
    sample: texts, about, whose frequent pre-tokens are looked up before a worker's cache.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    pieces = _frequent(docs, spec, sample)
    sizes = Encoder(spec, {}).whole(pieces) if pieces else []
    table = docs.sparkSession.sparkContext.broadcast((spec, dict(zip(pieces, sizes, strict=True))))

    def scan(batches):
        if _workers.get("of") is not table.value:
            _workers.update(of=table.value, encoder=Encoder(*table.value))
        encoder = _workers["encoder"]
        for batch in batches:
            for part in slices(batch):
                _, off = text_buffer(part.column("text"))
                n = encoder.lengths(part.column("text").to_pylist())
                n_bytes, n_tokens = pa.array(off[1:] - off[:-1], pa.int64()), pa.array(n, pa.int64())
                over = pa.array([x > limit for x in n], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, n_tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs).select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
