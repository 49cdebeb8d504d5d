"""BPE encoding and decoding with a public tokenizer file.

Method: batched numpy merge rounds.  The symbols of the distinct words of a
chunk of texts lie in one flat array; each round finds the lowest-rank pair of
every word by binary search of its pairs among the sorted pair keys, and merges
it in all words at once.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

#: Words whose ids a task remembers before it starts afresh.
REMEMBERED = 100_000
_NONE = np.iinfo(np.int64).max


def load(path: str) -> dict:
    """The tables of a tokenizer file of kind BPE with byte symbols and word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    rank = np.arange(len(pairs), dtype=np.int64)
    # A pair may be merged everywhere in a word at once if no rule that uses its result comes before it.
    first = {}
    for i, pair in enumerate(pairs):
        for part in pair:
            first.setdefault(vocab[part], i)
    safe = np.array([first.get(m, len(pairs)) >= i for i, m in enumerate(merged.tolist())], bool)
    order = np.argsort(key)
    tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    letters = byte_letters()
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "key": key[order], "merged": merged[order], "rank": rank[order], "safe": safe[order],
        "inner": np.array([vocab[letters[b]] for b in range(256)], np.int64),
        "last": np.array([vocab[letters[b] + end] for b in range(256)], np.int64),
        "tokens": [tokens.get(i, "") for i in range(max(tokens) + 1)],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "split": split,
    }


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next letter from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def merge_rounds(symbols: np.ndarray, word: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The merged symbols and the word of each, by word; ``word`` numbers the symbols' words in order."""
    key, merged, ranks, safe = model["key"], model["merged"], model["rank"], model["safe"]
    done_s, done_w = [], []
    while len(symbols):
        at = np.empty(0, np.int64)
        if len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.searchsorted(key, pair)
            at[at == len(key)] = 0
            same = (key[at] == pair) & (word[:-1] == word[1:])
        rank = np.full(len(symbols), _NONE)
        if len(at):
            rank[:-1][same] = ranks[at[same]]
        start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat(rank, start)
        best = np.repeat(best, np.diff(np.append(start, len(symbols))))
        open_ = best != _NONE
        if not open_.all():
            done_s.append(symbols[~open_])
            done_w.append(word[~open_])
        hit = np.flatnonzero((rank == best) & open_)
        if not len(hit):
            break
        # Pairs of one symbol with itself overlap: take every second of a run, from the left.
        fresh = np.concatenate(([True], (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]])))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        if not safe[at[hit]].all():
            again = np.concatenate(([False], word[hit[1:]] == word[hit[:-1]]))
            hit = hit[~again | safe[at[hit]]]
        symbols[hit] = merged[at[hit]]
        keep = open_
        keep[hit + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done_s:
        return symbols, word
    symbols, word = np.concatenate(done_s), np.concatenate(done_w)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


class Encoder:
    """Texts to ids, remembering the ids of a bounded number of distinct words."""

    def __init__(self, model: dict):
        self.model = model
        # White space only separates words, so it need not be rewritten before the split.
        self.find = regex.compile(model["split"].replace("\\s", "\\p{White_Space}")).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, model["special"])) + ")") if model["special"] else None
        self._forget()

    def _forget(self) -> None:
        # A word's number, and by number: its ids in one flat array, how many, and the text they decode to.
        # No word holds a control character before letters, so that marks special tokens.
        self.known = {"\0" + content: k for k, content in enumerate(self.model["special"])}
        self.flat = np.array(list(self.model["special"].values()), "<u4")
        self.size = np.ones(len(self.flat), np.int64)
        self.shown = list(self.model["special"])

    def words(self, text: str) -> list[str]:
        """The words of a text after normalisation; special tokens are marked by a control character."""
        if self.special is None or "<|" not in text:
            return self.find(self.normal(text))
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append("\0" + part)
            else:
                out += self.find(self.normal(part))
        return out

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Letter by letter, without the final form of sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, new: list[str]) -> None:
        """Merge words not met so far, all in one flat array."""
        raw = [w.encode() for w in new]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.model["inner"][flat]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.model["last"][flat[ends]]
        merged, word = merge_rounds(symbols, np.repeat(np.arange(len(new)), size), self.model)
        size = np.bincount(word, minlength=len(new))
        tokens, ids, at = self.model["tokens"], merged.tolist(), 0
        for k, (w, n) in enumerate(zip(new, size.tolist()), len(self.shown)):
            self.known[w] = k
            self.shown.append(" ".join([tokens[i] for i in ids[at : at + n]]))
            at += n
        self.flat = np.concatenate([self.flat, merged.astype("<u4")])
        self.size = np.concatenate([self.size, size])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """For each text its ids as little-endian 32-bit integers, and the text decoded from them."""
        if len(self.shown) > REMEMBERED:
            self._forget()
        split = [self.words(t) for t in texts]
        new = list({w for s in split for w in s if w not in self.known})
        if new:
            self.learn(new)
        start, known, text_of = np.cumsum(self.size) - self.size, self.known, self.shown
        ids, shown = [], []
        for s in split:
            number = [known[w] for w in s]
            at = np.array(number, np.int64)
            n = self.size[at]
            ids.append(self.flat[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            shown.append(" ".join([text_of[k] for k in number]))
        return ids, shown


def encode(df: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, ``token_ids`` and ``decoded`` of its whole texts.

    ``token_ids`` holds the ids as little-endian unsigned 32-bit integers,
    ``decoded`` what they decode to.  Null and empty texts have no token and
    decode to ''; rows are independent, so ties and repeated rows give equal
    values.  Columns of these three names are replaced, others stay.
    """
    model = load(path)

    def make():
        encoder = Encoder(model)

        def call(texts):
            ids, shown = encoder.encode(texts)
            return [[len(x) for x in ids], [x.tobytes() for x in ids], shown]

        return call

    added = T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType()),
    ])
    return map_text(df, text, added, make, carry)


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``, from ids as ``encode`` returns them; null ids decode to ''."""
    tokens = load(path)["tokens"]

    @F.pandas_udf(T.StringType())
    def shown(column):
        return column.map(lambda raw: " ".join([tokens[i] for i in np.frombuffer(raw or b"", "<u4").tolist()]))

    return df.withColumn("decoded", shown(F.col(ids)))


def digests(df: DataFrame) -> DataFrame:
    """The token count and the hashes of the ids and the decoded text of every document."""
    return df.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
