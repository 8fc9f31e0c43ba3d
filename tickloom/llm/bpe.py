"""BPE encoding and decoding by a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Shared, free, own_columns
from tickloom.llm.tokenfile import byte_symbols

CACHE_PIECES = 300_000
BATCH_PIECES = 5_000


class Merger:
    """Vocabulary and merges of one tokenizer file, and the index that applies them."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        d = json.loads(spec)
        model = d["model"]
        self.ids = model["vocab"]
        self.token = {i: t for t, i in self.ids.items()} | {a["id"]: a["content"] for a in d["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = [self.ids[a] for a, _ in merges]
        self.right = [self.ids[b] for _, b in merges]
        self.made = [self.ids[a + b] for a, b in merges]
        self.rank = {a << 20 | b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        self.library = Tokenizer.from_str(spec)
        self.plain = self._plain(d)
        self.number = {i: str(i) for i in self.token}
        self.visible = byte_symbols()
        self.words: dict[str, tuple[int, str, str]] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.fragments: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def _plain(d: dict):
        """The file's own split pattern for printable chunks of Latin-1, which NFC leaves alone; None if it says anything else."""
        steps = (d["pre_tokenizer"] or {}).get("pretokenizers") or []
        norms = [n["type"] for n in (d["normalizer"] or {}).get("normalizers", [])]
        if norms == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and \
                steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]:
            return regex.compile(steps[0]["pattern"]["Regex"])
        return None

    def pieces(self, chunk: str) -> list[str]:
        """The units that merges never cross, as strings of byte symbols."""
        if (found := self.latin(chunk)) is not None:
            return [*map(self._bytes, found)]
        lib = self.library
        text = lib.normalizer.normalize_str(chunk) if lib.normalizer else chunk
        return [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    def latin(self, text: str) -> list[str] | None:
        """The pieces of a text of printable Latin-1 as letters, whose bytes are not symbols yet; None for any other text."""
        if self.plain and text.isprintable() and (text.isascii() or max(text) < "\u0100"):
            return self.plain.findall(text.lower())
        return None

    def _bytes(self, letters: str) -> str:
        return letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.visible)

    def symbols(self, piece: str) -> list[int]:
        ids = self.ids
        try:
            return [*[ids[c] for c in piece[:-1]], ids[piece[-1] + self.suffix]]
        except KeyError:
            return [i for c in [*piece[:-1], piece[-1] + self.suffix] if (i := ids.get(c)) is not None]

    def merged(self, pieces: list[str]) -> list[list[int]]:
        """Ids of every piece. All pieces lie in one array; the index maps a pair's rank to its positions.

        Ranks with occurrences are taken in ascending order; each merge updates the lists of the two pairs it makes.
        Positions whose symbols have changed since they were listed are passed over.
        """
        sym = [-1]
        for p in pieces:
            sym += self.symbols(p)
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, left, right, made = self.rank.get, self.left, self.right, self.made
        where: dict[int, list[int]] = {}
        # a mark beside a symbol makes a negative number, which is no pair
        for i, r in enumerate(map(get, [a << 20 | b for a, b in zip(sym, sym[1:])])):
            if r is not None:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = left[r], right[r], made[r]
            at = where.pop(r)
            for p in sorted(at) if a == b else at:
                q = after[p]
                if sym[p] != a or sym[q] != b:
                    continue
                sym[p], sym[q] = c, -2
                z = after[p] = after[q]
                before[z] = p
                if (s := sym[o := before[p]]) >= 0 and (k := get(s << 20 | c)) is not None:
                    if k not in where:
                        where[k] = []
                        heapq.heappush(active, k)
                    where[k].append(o)
                if (s := sym[z]) >= 0 and (k := get(c << 20 | s)) is not None:
                    if k not in where:
                        where[k] = []
                        heapq.heappush(active, k)
                    where[k].append(p)
        out, rest, at = [], [s for s in sym if s != -2], 1
        for _ in pieces:
            end = rest.index(-1, at)
            out.append(rest[at:end])
            at = end + 1
        return out

    def learn(self, chunks: list[str]) -> None:
        """Adds (number of ids, ids as text, tokens joined by a space) of new chunks to the worker's table.

        Chunks share their pieces ("word", "Word,"), so a piece is merged once and remembered by itself.
        """
        cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        known, plan = self.known, []
        for chunk in chunks:
            steps = []
            for bit in cut.split(chunk) if cut and "<" in chunk else [chunk]:
                if bit in self.special:
                    steps.append(self._part([self.special[bit]]))
                elif bit:
                    steps += self.pieces(bit)
            plan.append(steps)
        fresh = list(dict.fromkeys([p for steps in plan for p in steps if isinstance(p, str) and p not in known]))
        known.update(zip(fresh, map(self._part, self.merged(fresh))))
        for chunk, steps in zip(chunks, plan):
            parts = [f for p in steps if (f := known[p] if isinstance(p, str) else p)[0]]
            self.fragments[chunk] = parts[0] if len(parts) == 1 else (
                sum([f[0] for f in parts]), " ".join([f[1] for f in parts]), " ".join([f[2] for f in parts]))

    def _part(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.number[i] for i in ids]), " ".join([self.token[i] for i in ids])

    def parts(self, texts):
        """The fragments of each text in turn.

        A plain text is cut into its pieces at once. In others white space ends a piece, so what lies between is encoded
        by itself. Both are remembered in the worker. Texts are taken together until they have BATCH_PIECES new pieces
        or chunks; those go through one index.
        """
        waiting, words, chunks = [], {}, {}
        for text in texts:
            if not waiting:
                for table in (self.words, self.known, self.fragments):
                    if len(table) > CACHE_PIECES:
                        table.clear()
            text = text.replace("\n", " ")
            units, table, fresh = self.latin(text), self.words, words
            if units is None or any(t in text for t in self.special):
                units, table, fresh = [c for c in text.split(" ") if c], self.fragments, chunks
            waiting.append((units, table))
            fresh |= dict.fromkeys([u for u in units if u not in table])
            if len(words) + len(chunks) >= BATCH_PIECES:
                yield from self._flush(waiting, words, chunks)
                waiting, words, chunks = [], {}, {}
        yield from self._flush(waiting, words, chunks)

    def _flush(self, waiting, words, chunks):
        self.words.update(zip(words, map(self._part, self.merged([*map(self._bytes, words)]))))
        self.learn(list(chunks))
        for units, table in waiting:
            yield [f for u in units if (f := table[u])[0]]


def tokenizer_spec(path: str | None = None, name: str = "word_bpe_49k.json") -> str:
    """The file's text, read once on the driver: a few MB at most, so it may go to every executor."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _merger(df: DataFrame, path: str | None) -> Shared:
    return Shared(df.sparkSession, "merger", tokenizer_spec(path), Merger)


def encode(df: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """Adds the ids of every whole text as array<int>; null and empty texts give an empty array.

    Special tokens of the file are recognised in the text, none are added. A column named ``into`` is replaced.
    """
    merger = _merger(df, path)

    @F.pandas_udf("array<int>")
    def ids(column: pd.Series) -> pd.Series:
        m = merger.get()
        found = m.parts(column.fillna("").tolist())
        return pd.Series([[int(i) for f in parts for i in f[1].split(" ")] for parts in found])

    return df.withColumn(into, ids(F.col(f"`{text}`")))


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the tokens' strings joined by a space: the file has no decoder, and this is what the library then does.

    Null ids give an empty text; ids outside the vocabulary are passed over.
    """
    merger = _merger(df, path)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        token = merger.get().token
        return pd.Series([" ".join([token[i] for i in x if i in token]) if x is not None else "" for x in column])

    return df.withColumn(into, text(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 without bringing ids or decoded texts back to the JVM.

    A null text counts as empty; long texts are encoded whole; repeated rows come back as often as given, with the same
    result. Columns of these three names are replaced, all others come back as they are. An empty table stays empty.
    """
    merger = _merger(df, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(column: pd.Series) -> pd.DataFrame:
        m, rows = merger.get(), []
        for parts in m.parts(column.fillna("").tolist()):
            rows.append((
                sum([f[0] for f in parts]), hashlib.sha256(" ".join([f[1] for f in parts]).encode()).hexdigest(),
                hashlib.sha256(" ".join([f[2] for f in parts]).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    into, = free(df, "d")
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return df.withColumn(into, digests(F.col(f"`{text}`"))).select(
        *own_columns(df, *names), *[F.col(f"{into}.{c}") for c in names])


def encoded_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) as doc_id and the digests of ``round_trip``; other columns are not read."""
    return round_trip(docs.select("doc_id", "text"), path=path).drop("text")
