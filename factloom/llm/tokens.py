"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary is compiled into a deterministic transducer over the
bytes of a pretoken. Its state after a prefix is all that the future can depend
on: the longest suffix that begins some vocabulary entry, and for every position
inside that suffix the last token of the encoding that ends there and its count
relative to the present one. A transition reads one byte and carries the change
of the number of tokens, so the sum of the carried numbers along a pretoken is
its token count. States are made when first reached (there are finitely many;
the tables are dropped and grown anew beyond ``MOST_STATES``).

That the last token decides rests on a property of BPE: a sequence of entries is
the encoding of its bytes exactly if every two neighbours are the encoding of
theirs. Two entries are compatible if encoding their bytes gives them back.

A text is cut into chunks of ``CHUNK`` characters anywhere. What a chunk does to
the count, whatever state it is entered in, is its state map. Every certain
boundary (a space after a non-space, which the split pattern never joins) sends
all states to the first one, so a map is constant behind its first certain
boundary and is held as three things: the characters before that boundary, which
any entry state has still to read; the count from there to the last certain
boundary; and the characters behind it, which stand for the state at the end,
because the split pattern looks ahead. A chunk without a certain boundary is held
as its characters, and such neighbours are joined. The maps compose associatively
and are combined as a parallel prefix scan combines them, in a balanced tree,
within one task. Words that a worker has met are remembered with their counts;
the transducer reads those that it hasn't.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings
inside a text count as the library's default has them (one token each); a
repeated row or a null id gives a row of its own; other columns are ignored; an
empty table gives an empty result. Texts are never cut off.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map

#: Characters of a chunk, and the states and pretoken runs that a worker remembers.
CHUNK, MOST_STATES, REMEMBERED = 1 << 14, 400_000, 600_000
#: A document of more tokens is over the limit.
LIMIT = 512

# The split pattern of byte-level BPE, and Unicode's white space.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SPACE\p{L}\p{N}]+|[SPACE]+(?![^SPACE])|[SPACE]+"
).replace("SPACE", SPACE)


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_MARKS = frozenset(".,;:!?")


class Transducer:
    """Counts the tokens of pretokens; compiled from merges in order of rank."""

    def __init__(self, merges: list[tuple[bytes, bytes]], whole: dict[bytes, int] | None = None) -> None:
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.tokens = tokens
        self.beginnings = {t[:i] for t in tokens for i in range(1, len(t))}
        self.longest = max(map(len, tokens))
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._restart()

    def _restart(self) -> None:
        # a state: (suffix, ((last token, tokens before the present count), ...) for each position in it)
        self.states: list[tuple[bytes, tuple]] = [(b"", ((b"", 0),))]
        self.known = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}  # 256 * state + byte -> (256 * next state, change of the count)

    def merge(self, text: bytes) -> list[bytes]:
        """The encoding of a few bytes by the definition: the pair of lowest rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        if (fits := self.fits.get(pair)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            fits = self.fits[pair] = self.merge(left + right) == [left, right]
        return fits

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The state after one more byte, and the change of the count."""
        suffix, ends = self.states[state >> 8]
        grown = suffix + bytes([byte])
        token, before = b"", 0
        for size in range(min(len(grown), self.longest), 0, -1):
            piece = grown[-size:]
            if piece not in self.tokens:
                continue
            last, count = ends[len(grown) - size]
            if not last or self.compatible(last, piece):
                token, before = piece, count
                break
        delta = before + 1
        ends = tuple((t, c - delta) for t, c in ends) + ((token, 0),)
        keep = next((len(grown) - i for i in range(len(grown)) if grown[i:] in self.beginnings), 0)
        after = (grown[len(grown) - keep :], ends[len(ends) - keep - 1 :])
        k = self.known.get(after)
        if k is None:
            k = self.known[after] = len(self.states)
            self.states.append(after)
        step = self.moves[state + byte] = k << 8, delta
        return step

    def count(self, pretoken: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self._restart()
        state = total = 0
        moves = self.moves
        for byte in pretoken:
            try:
                state, delta = moves[state + byte]
            except KeyError:
                state, delta = self._move(state, byte)
            total += delta
        return total


class Counter:
    """Token counts of texts: split pattern, transducer, chunk maps and their composition."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str]) -> None:
        self.machine = Transducer(merges)
        self.split = regex.compile(PATTERN)
        # runs that the split pattern never joins: a space always begins a pretoken after a non-space
        self.runs = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.space = regex.compile(f"[{SPACE}]")
        self.inner = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
        self.last = regex.compile(rf"(?r)(?<=[^{SPACE}])(?=[{SPACE}])")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.seen: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def pretoken(self, text: str) -> int:
        """The count of one pretoken, remembered."""
        if (n := self.words.get(text)) is None:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            n = self.machine.count(text.encode("utf-8", "surrogatepass"))
            if len(text) < 64:
                self.words[text] = n
        return n

    def run(self, text: str) -> int:
        """The count of one run, remembered; a word and a word with one mark need no search for their parts."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        body = text[1:] if text[0] == " " else text
        if body.isalpha():
            n = self.pretoken(text)
        elif body[-1:] in _MARKS and body[:-1].isalpha():
            n = self.pretoken(text[:-1]) + self.pretoken(body[-1])
        else:
            n = sum(map(self.pretoken, self.split.findall(text)))
        if len(text) < 64:
            self.seen[text] = n
        return n

    def between(self, text: str) -> int:
        """The count of a text that stands between certain boundaries."""
        get, run = self.seen.get, self.run
        return sum([n if (n := get(r)) is not None else run(r) for r in self.runs.findall(text)])

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | str:
        """(head, count, tail), or the chunk itself if no boundary in it is certain."""
        first = self.inner.search(chunk)
        if first is None:
            return chunk
        a, b = first.start(), self.last.search(chunk).start()
        return chunk[:a], self.between(chunk[a:b]), chunk[b:]

    def compose(self, left: tuple[str, int, str] | str, right: tuple[str, int, str] | str) -> tuple[str, int, str] | str:
        """The map of two neighbours; associative."""
        if isinstance(left, str) and isinstance(right, str):
            return self.rejoin(left, right)
        if isinstance(left, str):
            joined = self.rejoin(left, right[0])
            if isinstance(joined, str):
                return joined, right[1], right[2]
            return joined[0], joined[1] + self.between(joined[2]) + right[1], right[2]
        if isinstance(right, str):
            joined = self.rejoin(left[2], right)
            if isinstance(joined, str):
                return left[0], left[1], joined
            return left[0], left[1] + self.between(joined[0]) + joined[1], joined[2]
        return left[0], left[1] + self.between(left[2] + right[0]) + right[1], right[2]

    def rejoin(self, left: str, right: str) -> tuple[str, int, str] | str:
        """The map of two strings without boundaries inside; the seam may be one."""
        if left and right and not self.space.match(left[-1]) and self.space.match(right[0]):
            return left, 0, right
        return left + right

    def plain(self, text: str) -> int:
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # each level composes neighbours independently of each other
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        whole = maps[0]
        return self.between(whole) if isinstance(whole, str) else self.between(whole[0]) + whole[1] + self.between(whole[2])

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    """The counter of a byte-level BPE tokenizer file (``tokenizers`` JSON)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    merges = [(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in pairs]
    return Counter(merges, [t["content"] for t in spec.get("added_tokens", [])])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Bytes and tokens of every whole text. The file at ``tokenizer`` must be on every executor."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        count = load(tokenizer or default_tokenizer())
        raw = b.column(1)
        sizes = [0 if x is None else len(x) for x in raw.cast(pa.binary()).to_pylist()]
        tokens = [count(t) if t else 0 for t in raw.to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        batch,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
