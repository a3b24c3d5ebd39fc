"""BPE encoding and decoding by backtracking over longest token matches.

The encoder walks a piece of text (a pre-token) with the longest tokens that Aho-Corasick finds at each place. Two
neighbours must be a compatible pair: merging their bytes would leave both standing. Where they aren't, it takes
the next shorter token at that place, or steps back and marks the place as dead. This gives the ids of the merge
procedure, in time linear in the piece. Decoding reads token bytes through an offset table.

A null text is empty: no ids and an empty decoded text. Long texts are encoded whole, equal rows give equal results, an empty table none, and other columns
are not read. A special token written in a text is encoded as that token, as the
tokenizers library does unless told otherwise.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import read_table

VOCABULARY = "byte_bpe_50k.json"
#: Pieces whose encodings a worker keeps at once; beyond it the table starts anew.
KEPT = 400_000

# The pattern that cuts text into pieces before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
# The white space code points of Unicode.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class _Kept(dict):
    """Runs and what ``find`` gives for them, filled in as they are asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, run: str):
        if len(self) >= KEPT:
            self.clear()
        found = self[run] = self.find(run)
        return found


class Bpe:
    """Encoder and decoder of one vocabulary file's content."""

    def __init__(self, content: str):
        import ahocorasick
        import regex

        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t.encode() for t, i in self.special.items()}
        self.by_bytes: dict[bytes, int] = {}
        for letters, i in vocab.items():
            if i not in names:
                names[i] = bytes(to_byte[c] for c in letters)
                self.by_bytes[names[i]] = i
        # The offset table: all token bytes in one run, and where each id starts.
        ends = np.cumsum([len(names.get(i, b"")) for i in range(max(names) + 1)])
        self.offsets = np.concatenate([[0], ends]).tolist()
        self.all_bytes = b"".join(names.get(i, b"") for i in range(max(names) + 1))
        self.sizes = [b - a for a, b in zip(self.offsets, self.offsets[1:])]
        # Merges: the rank of a pair, and for each merged token its two halves and rank.
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ids = vocab[left], vocab[right]
            whole = vocab[left + right]
            self.merged.setdefault(ids, (rank, whole))
            self.halves.setdefault(whole, (rank, *ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        # A token that its own merges never make can't stand in any encoding.
        self.matches = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        usable = {b: i for b, i in self.by_bytes.items() if self._reachable(i)}
        for b, i in usable.items():
            self.matches.add_word(b.decode("latin-1"), (len(b) - 1, i))
            for k in range(len(b) - 1, 0, -1):
                if b[:k] in usable:
                    self.shorter[i] = usable[b[:k]]
                    break
        self.matches.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.runs = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kept = _Kept(self._run)

    def _reachable(self, token: int) -> bool:
        if token not in self.halves:
            return True
        _, left, right = self.halves[token]
        return self._reachable(left) and self._reachable(right) and self._stands(left, right, self.halves[token][0])

    def _stands(self, left: int, right: int, before: int) -> bool:
        """No merge of a rank under ``before`` joins the two tokens' bytes across their border.

        Undo merges on either side, latest first: what then touches at the border is what stood there at that rank.
        """
        halves, merged = self.halves, self.merged
        while True:
            found = merged.get((left, right))
            if found is not None and found[0] < before:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            # At equal ranks merges run from left to right, so the right side's merge comes last.
            if b is None or (a is not None and a[0] > b[0]):
                before, left = min(before, a[0]), a[2]
            else:
                before, right = min(before, b[0] + 1), b[1]

    def compatible(self, left: int, right: int) -> bool:
        """An entry of the pair-compatibility table, filled in as it is asked for."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            found = self.pairs[left, right] = self._stands(left, right, 1 << 60)
        return found

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.by_bytes.get(raw)
        if whole is not None and whole in self.shorter or len(raw) == 1:
            return [whole]
        size = len(raw)
        longest = [0] * size
        for end, (less, token) in self.matches.iter(raw.decode("latin-1")):
            longest[end - less] = token  # matches come by their ends, so the last one of a place is the longest
        out: list[int] = []
        at, dead, token = 0, set(), longest[0]
        sizes, pairs = self.sizes, self.pairs
        while at < size:
            end = at + sizes[token]
            if end not in dead and (not out or pairs.get(pair := (out[-1], token)) or pair not in pairs and self.compatible(*pair)):
                out.append(token)
                at = end
                if at < size:
                    token = longest[at]
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        o, b = self.offsets, self.all_bytes
        return b"".join([b[o[i] : o[i + 1]] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._parts(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece in self.pieces.findall(part):
                    out += self.encode_piece(piece)
        return out

    def _parts(self, text: str) -> list[str]:
        return [p for p in self.specials.split(text) if p] if self.specials else [text]

    def _run(self, run: str) -> tuple[str, int, bytes]:
        """Ids as text, their number and their decoded bytes, for white space and what follows it up to the next."""
        if run[1:].isalpha() and run[0] == " ":  # letters after a space are one piece, as nearly all runs are
            ids = self.encode_piece(run)
        elif run[-1] in ".," and run[1:-1].isalpha() and run[0] == " ":
            ids = self.encode_piece(run[:-1]) + self.encode_piece(run[-1])
        else:
            ids = [i for piece in self.pieces.findall(run) for i in self.encode_piece(piece)]
        return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and the digests of the ids and of the decoded text. Pieces never cross from a run to the next."""
        found = []
        for part in self._parts(text or ""):
            if part in self.special:
                i = self.special[part]
                found.append((str(i), 1, self.decode_bytes([i])))
            else:
                found += map(self.kept.__getitem__, self.runs.findall(part))
        named, counts, raw = zip(*found) if found else ((), (), ())
        decoded = b"".join(raw).decode("utf-8", "replace")
        return sum(counts), hashlib.sha256(",".join(named).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_loaded: dict[str, Bpe] = {}


def load(content: str) -> Bpe:
    """The encoder of a vocabulary, built once in each worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(content)
    return _loaded[key]


def _content(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def _vocabulary(df: DataFrame, path: str | None):
    """The driver reads the vocabulary (a few MB) and sends it to the workers."""
    return df.sparkSession.sparkContext.broadcast(_content(path))


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    content = _vocabulary(docs, path)

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        bpe = load(content.value)
        return pd.Series([bpe.encode(t or "") for t in texts])

    return docs.select("doc_id", encoded("text").alias("ids"))


def decode_ids(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids)."""
    content = _vocabulary(ids, path)

    @F.pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        bpe = load(content.value)
        return pd.Series([bpe.decode([] if x is None else list(x)) for x in rows])

    return ids.select("doc_id", decoded("ids").alias("text"))


def digest_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, then decoded from the ids."""
    content = _vocabulary(docs, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(texts: pd.Series) -> pd.DataFrame:
        bpe = load(content.value)
        return pd.DataFrame([bpe.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digested("text").alias("d")).select("doc_id", "d.*")


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digest_texts(read_table(spark, sf_dir, "documents"), path)
