"""Token ids of whole texts, encoded by the tokenizers library chunk by chunk.

The tokenizer's pre-tokens never span white space, so the ids of a text are the ids of its
white-space chunks in order. A bounded table of chunks already encoded makes this several times
faster than encoding every text anew, with the same ids. A new chunk that is one word of
letters, perhaps with punctuation behind it, goes straight to the tokenizer's model; every
other one through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import hand_back, worker_table

ID_BYTES = 4
#: ASCII punctuation that forms a pre-token of its own behind a word.
_TAIL = ".,!?;:%$#*&|)]}-"
#: Letters whose lower case depends on their surroundings or takes two code points.
_ODD_CASE = ("Σ", "İ")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next
    free code point from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: ASCII bytes by kind: punctuation and controls as ".", everything else as "a".
_KINDS = bytes(0x61 if b >= 0x80 or chr(b).isalnum() or chr(b) in " \t\n\r\x0b\x0c" else 0x2E for b in range(256))


def _fewer_kinds(text: bytes) -> bytes:
    """The text with fewer different chunks and the same ids. ASCII letters are lower-cased
    unless a combining mark might compose with them; commas and full stops part from the
    word before them where no run of punctuation can be broken by that."""
    if b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    if text.isascii() and b".." not in text.translate(_KINDS):
        text = text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n")
    return text


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the tokenizer does when called with
    add_special_tokens=False: strings of its added tokens inside a text become those tokens."""

    def __init__(self, tokenizer_path: str, most_chunks: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # Between the added tokens nothing is one, whatever lower-casing makes of it.
        self._path, self._tokenizer = tokenizer_path, Tokenizer.from_file(tokenizer_path)
        self._tokenizer.encode_special_tokens = True
        self._model = self._tokenizer.model
        self._most = most_chunks
        self._known: dict[bytes, bytes] = {b"": b""}
        self._tails: dict[str, bytes] = {}
        self._letters = _byte_letters()
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        #: Added tokens that are cut out of the raw text before anything else; what is between them is
        #: encoded as if it stood alone. Texts with other added tokens go through the tokenizer whole.
        self._plain = {t["content"].encode(): struct.pack("<I", t["id"]) for t in added if not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])}
        self._other = [t["content"].lower().encode() for t in added if t["content"].encode() not in self._plain]
        self._cut = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self._plain, key=len, reverse=True)) + b")") if self._plain else None
        kinds = {k for part in ("normalizer", "pre_tokenizer") for k in self._kinds(spec.get(part))}
        #: Only for this layout is a lower-case word of letters one pre-token of byte letters.
        self._direct = set(kinds) == {"NFC", "Replace", "Lowercase", "Split", "ByteLevel"}

    @staticmethod
    def _kinds(step: dict | None) -> list[str]:
        if not step:
            return []
        inner = step.get("normalizers") or step.get("pretokenizers")
        return [s["type"] for s in inner] if inner else [step["type"]]

    def _whole(self, texts: list[str], tokenizer=None) -> list[bytes]:
        made = (tokenizer or self._tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(m.ids)}I", *m.ids) for m in made]

    def _learn(self, chunks: set[bytes]) -> None:
        known, odd = self._known, []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            low = text.lower()
            word = low.rstrip(_TAIL)
            if not (self._direct and word.isalpha() and (text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) and not any(c in text for c in _ODD_CASE)))):
                odd.append(chunk)
                continue
            key = word.encode()
            ids = known.get(key)
            if ids is None:
                spelt = word if word.isascii() else key.decode("latin-1").translate(self._letters)
                made = [t.id for t in self._model.tokenize(spelt)]
                ids = known[key] = struct.pack(f"<{len(made)}I", *made)
            if len(word) < len(low):
                tail = low[len(word) :]
                if tail not in self._tails:
                    self._tails[tail] = self._whole([tail])[0]
                ids = ids + self._tails[tail]
            known[chunk] = ids
        for at in range(0, len(odd), 10_000):
            part = odd[at : at + 10_000]
            known.update(zip(part, self._whole([c.decode("utf-8", "replace") for c in part])))

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """The ids of each text, each followed by ``end_id``."""
        end = struct.pack("<I", end_id)
        apart = [i for i, t in enumerate(texts) if any(x in t.lower() for x in self._other)]
        whole = [texts[i] for i in apart]
        texts = [b"" if i in apart else t for i, t in enumerate(texts)] if apart else texts
        pieces = [self._cut.split(t) if self._cut is not None and any(x in t for x in self._plain) else [t] for t in texts]
        made = self._encode([p for some in pieces for p in some[::2]])
        out, at = [], 0
        for some in pieces:
            n = (len(some) + 1) // 2
            ids = made[at : at + n]
            out.append((ids[0] if n == 1 else b"".join(x for k in range(n) for x in (ids[k], self._plain[some[2 * k + 1]] if k < n - 1 else b""))) + end)
            at += n
        if apart:
            from tokenizers import Tokenizer

            for i, ids in zip(apart, self._whole([t.decode("utf-8", "replace") for t in whole], Tokenizer.from_file(self._path))):
                out[i] = ids + end
        return out

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts without added tokens. Every different chunk of them is looked up
        once; Arrow splits the texts and puts the ids back in place."""
        known = self._known
        if len(known) > self._most:
            for key in list(islice(known, len(known) // 2)):
                del known[key]
        if len(self._tails) > 10_000:
            self._tails.clear()
        if self._direct:
            texts = [_fewer_kinds(t) for t in texts]
        split = pc.ascii_split_whitespace(pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        different = coded.dictionary.cast(pa.large_binary()).to_pylist()
        ids = list(map(known.get, different))
        missing = {c for c, v in zip(different, ids) if v is None}
        if missing:
            self._learn(missing)
            ids = [known[c] if v is None else v for c, v in zip(different, ids)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // ID_BYTES
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(ids), "<u4"), pa.uint32()))
        at = coded.indices.to_numpy(zero_copy_only=False)
        raw = lists.take(coded.indices).flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[split.offsets.to_numpy()] * ID_BYTES
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encoder(tokenizer_path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer."""
    return worker_table(f"tokenizer {tokenizer_path}", lambda: ChunkEncoder(tokenizer_path))


def encoded_groups(texts, end_id: int, tokenizer_path: str, group_bytes: int = 4_000_000):
    """Ids of each text in order, encoding texts of about ``group_bytes`` together."""
    enc, group, size = encoder(tokenizer_path), [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= group_bytes:
            yield from enc.encode(group, end_id)
            group, size = [], 0
            hand_back()
    if group:
        yield from enc.encode(group, end_id)
        hand_back()
