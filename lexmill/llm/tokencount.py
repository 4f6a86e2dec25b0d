"""Token counts by a compiled finite-state tokenizer.

The BPE tokenizer of a file becomes a deterministic transducer over the bytes of a word. Its state knows, for
each suffix of the read prefix that can still grow into a token, which token the encoding had before that suffix;
an arc reads a byte and carries the change in the number of emitted tokens; a final arc closes the word.
It rests on the fact that a sequence of tokens is the BPE encoding of its text if and only if each two neighbours are:
so every prefix has exactly one last token that goes with the token before it. States and arcs are built when first
met and kept for all later words of the process, as are the results of whole words (both bounded).

White space always returns the tokenizer to its start, so the state map of any chunk of text is: finish
the word that enters, count the words inside, hand on the word that leaves. These maps compose associatively;
long texts are cut into chunks whose maps are combined by a balanced reduction.

Defined cases: null and empty texts have 0 tokens and 0 bytes. Special strings of the file count as one token each.
Rows are counted one by one, so repeats, ties and hot sources change nothing. Extra columns are kept.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import task_batches
from .packing import byte_letters

#: Python's str.split() also splits at these four; the tokenizer's white space doesn't hold them.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


class Transducer:
    """Counts the BPE tokens of a word (bytes)."""

    MOST = 800_000  # arcs, closing arcs or checked pairs that are kept

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = {c: b for b, c in byte_letters().items()}
        as_key = lambda token: (bytes(letters[c] for c in token.removesuffix(suffix)), token.endswith(suffix)) if suffix else (bytes(letters[c] for c in token), True)
        self.ids: dict[tuple[bytes, bool], int] = {}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        tokens: dict[str, int] = {}
        for a, b in pairs:
            for t in (a, b, a + b):
                tokens.setdefault(t, len(tokens))
        for c in byte_letters().values():
            for t in (c, c + suffix):
                tokens.setdefault(t, len(tokens))
        n = len(tokens)
        #: For each token: its halves and the rank of its merge (none for single bytes).
        self.halves, self.rank = [None] * n, [1 << 40] * n
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            t = tokens[a + b]
            self.pair.setdefault((tokens[a], tokens[b]), r)
            if self.halves[t] is None and len(a + b) > 1:
                self.halves[t], self.rank[t] = (tokens[a], tokens[b]), r
        # The trie of all tokens; a node: children, token inside a word, token that ends a word.
        self.children: list[dict[int, int]] = [{}]
        self.inner: list[int | None] = [None]
        self.final: list[int | None] = [None]
        for token, i in tokens.items():
            text, ends = as_key(token)
            node = 0
            for b in text:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.inner.append(None)
                    self.final.append(None)
                node = nxt
            if suffix:
                (self.final if ends else self.inner)[node] = i
            else:
                self.inner[node] = self.final[node] = i
        self._chains: tuple[dict, dict] = ({}, {})
        self._good: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self):
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.arcs: dict[int, tuple[int, int]] = {}
        self.closes: dict[int, int] = {}
        self.start = self._number(((0, -1, 0),))

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at a token's edge while it is built, each with the rank of the merge that consumes it."""
        out = self._chains[side].get(token)
        if out is None:
            out, t, until = [], token, 1 << 41
            while True:
                out.append((t, until))
                if self.halves[t] is None:
                    break
                until, t = self.rank[t], self.halves[t][side]
            out.reverse()
            self._chains[side][token] = out
        return out

    def together(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its own text: no merge across the border comes first."""
        good = self._good.get((a, b))
        if good is None:
            left, right, i, j, good = self._edge(a, 1), self._edge(b, 0), 0, 0, True
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                r = self.pair.get((x, y))
                if r is not None and r < until_x and r <= until_y:
                    good = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            if len(self._good) > self.MOST:
                self._good.clear()
            self._good[a, b] = good
        return good

    def _step(self, state: tuple, byte: int, tokens: list) -> tuple[list, int, int]:
        """(suffixes after the byte, the one token of `tokens` that ends there, its count)."""
        grown, found, count = [], -1, 0
        for node, last, rel in state:
            child = self.children[node].get(byte)
            if child is not None:
                grown.append((child, last, rel))
                t = tokens[child]
                if found < 0 and t is not None and (last < 0 or self.together(last, t)):
                    found, count = t, rel + 1
        return grown, found, count

    def arc(self, key: int) -> tuple[int, int]:
        grown, token, count = self._step(self.states[key >> 8], key & 255, self.inner)
        nxt = tuple((c, last, rel - count) for c, last, rel in grown if self.children[c]) + ((0, token, 0),)
        out = self.arcs[key] = (self._number(nxt) << 8, count)
        return out

    def close(self, key: int) -> int:
        _, token, count = self._step(self.states[key >> 8], key & 255, self.final)
        self.closes[key] = count
        return count

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        if len(self.arcs) > self.MOST or len(self.closes) > self.MOST:
            self._clear()
        state, total, arcs = self.start << 8, 0, self.arcs
        for b in word[:-1]:
            nxt = arcs.get(state | b) or self.arc(state | b)
            state = nxt[0]
            total += nxt[1]
        key = state | word[-1]
        last = self.closes.get(key)
        return total + (self.close(key) if last is None else last)


class Counter(dict):
    """piece of text without white space -> its number of tokens."""

    MAX_PIECES = 600_000

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [x["type"] for x in (norm or {}).get("normalizers", [norm] if norm else [])]
        steps = pre.get("pretokenizers", [pre])
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
            raise ValueError(f"{path}: only word-level BPE files are compiled here")
        self.find = regex.compile(steps[0]["pattern"]["Regex"], regex.V1).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) + ")") if spec["added_tokens"] else None
        self.names = [t["content"] for t in spec["added_tokens"]]
        self.machine = Transducer(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.spaces = regex.compile(_SPACES)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.MAX_PIECES:
            self.clear()
        total, parts = 0, [piece]
        if "<" in piece and any(s in piece for s in self.names):
            parts = self.special.split(piece)
            total, parts = len(parts) // 2, parts[::2]
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()  # letter by letter: no form of final sigma
            for word in self.find(part):
                total += self.machine.count(word.encode())
        if len(piece) < 64:
            self[piece] = total
        return total

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(the word that enters, tokens of the words inside, the word that leaves); the last is None if no space stands in text."""
        odd = any(c in text for c in _NOT_SPACE)
        pieces = self.spaces.split(text) if odd else text.split()
        if odd:
            first, rest = pieces[0], pieces[1:]
            return (first, sum(map(self.__getitem__, filter(None, rest[:-1]))), rest[-1]) if rest else (first, 0, None)
        if not pieces:
            return ("", 0, "" if text else None)
        enters, leaves = not text[0].isspace(), not text[-1].isspace()
        if len(pieces) == 1 and enters and leaves:
            return (pieces[0], 0, None)
        head = pieces[0] if enters else ""
        tail = pieces[-1] if leaves else ""
        inside = pieces[enters : len(pieces) - leaves]
        return (head, sum(map(self.__getitem__, inside)), tail)

    def compose(self, a, b):
        if a[2] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[2] is None:
            return (a[0], a[1], a[2] + b[0])
        word = a[2] + b[0]
        return (a[0], a[1] + b[1] + (self[word] if word else 0), b[2])

    def count(self, text: str | None, chunk: int = 1 << 16) -> int:
        if not text:
            return 0
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, inside, tail = maps[0]
        return (self[head] if head else 0) + inside + (self[tail] if tail else 0)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, text="text", out="n_tokens") -> DataFrame:
    """docs with the number of tokens of each text (long)."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches):
        import pyarrow as pa

        count = counter(tokenizer).count
        for table in task_batches(batches, None, 1 << 12):
            yield from table.append_column(out, pa.array([count(t) for t in table[text].to_pylist()], pa.int64())).to_batches()

    return docs.mapInArrow(run, schema)


def token_digest(docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    counted = count_tokens(docs.select(doc_id, text), tokenizer, text=text)
    return counted.select(doc_id, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
