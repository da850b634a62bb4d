"""Byte-pair encoding by speculation: propose tokens, verify all pairs at once, merge exactly only what fails.

For each distinct word a greedy longest match proposes tokens. A row of tokens is the word's encoding if and only if
no merge would have crossed the border of two neighbours, and whether one would can be told from the two alone: it
does if symbols that end the left one and begin the right one at some moment form a merge of a lower rank than the
merges that end them. numpy walks these symbols for all distinct pairs of a batch side by side. Words with a pair that
fails are merged one merge after another.

That holds for vocabularies in which each token is made by one merge, whose parts are older than itself; others are
refused. Normalisation and the cut into words are those that the tokenizer's file declares. They never reach across
white space, so a task keeps what it made of a run of other characters and looks it up when that comes again.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gapwise.llm.common import chunks, in_arrow, without

#: What no word reaches across: the white space of Unicode. (str.split() knows more.)
RUN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Added to the code point of a word's last character, which makes it another symbol. Byte symbols are below it.
LAST = 0x1000
#: Marks special tokens among words, which have no such character.
SPECIAL = "\x00"
#: Words and runs that a worker keeps, and ids of either, before it forgets them.
MOST_WORDS, MOST_RUNS, MOST_IDS = 500_000, 700_000, 4_000_000
NEVER = np.iinfo(np.int64).max
#: Symbols up to which words are proposed side by side, and merged by looking at all their pairs.
SHORT = 48


class Vocabulary:
    """Tokens, merges and text rules of a tokenizer's file. Its size is that of the file, whatever is encoded."""

    def __init__(self, declared: str):
        d = json.loads(declared)
        model, added = d["model"], d["added_tokens"]
        self.end = model.get("end_of_word_suffix") or ""
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or not self.end or any(model.get(k) for k in plain) or d["decoder"] or any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("not a plain byte-pair vocabulary with word ends")
        kinds = [x["type"] for x in d["normalizer"]["normalizers"]], [(x["type"], x.get("behavior"), x.get("invert"), x.get("use_regex")) for x in d["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], [("Split", "Removed", True, None), ("ByteLevel", None, None, False)]):
            raise ValueError("other rules of normalisation, or of the cut into words")
        self.rules = json.dumps(d | {"added_tokens": [], "truncation": None, "padding": None, "model": {"type": "BPE", "vocab": {}, "merges": []}})
        vocab = model["vocab"]
        #: Text of each id, for decoding; None for ids without a token.
        self.names: list[str | None] = [None] * (1 + max(*vocab.values(), *(a["id"] for a in added)))
        for name, i in [*vocab.items(), *((a["content"], a["id"]) for a in added)]:
            self.names[i] = name
        self.special = {a["content"]: a["id"] for a in added}
        self.n = len(self.names)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = np.full(self.n, -1, np.int64)
        self.left, self.right = np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.rank[k] >= 0 or max(self.rank[i], self.rank[j]) >= r:
                raise ValueError("a token is made by several merges, or before its parts")
            self.rank[k], self.left[k], self.right[k] = r, i, j
        made = np.flatnonzero(self.rank >= 0)
        pair = self.left[made] * self.n + self.right[made]
        order = np.argsort(pair)
        self.pairs, self.made = pair[order], made[order]
        #: Rank of each merge, and what the merge of a rank makes.
        self.ranks = dict(zip(self.pairs.tolist(), self.rank[self.made].tolist(), strict=True))
        self.makes = self.made[np.argsort(self.rank[self.made])].tolist()
        # a token that its own letters don't encode to is in no encoding
        sound = np.ones(self.n, bool)
        for k in made[np.argsort(self.rank[made])]:
            sound[k] = sound[self.left[k]] and sound[self.right[k]]
        sound[made] &= ~self.crossed(self.left[made], self.right[made], below=self.rank[made])
        for k in made[np.argsort(self.rank[made])]:
            sound[k] = sound[k] and sound[self.left[k]] and sound[self.right[k]]
        self.spelled = {self.spelling(name): i for name, i in vocab.items() if sound[i]}
        self.longest = max(map(len, self.spelled))
        self._grow_trie()
        self.kept: Encoder | None = None

    def _grow_trie(self) -> None:
        """Prefixes of all tokens: an edge's key is its node's number and its symbol's, and some nodes are a token's end."""
        letters = sorted({c for name in self.spelled for c in name})
        self.symbol = np.full(2 * LAST, -1, np.int64)
        self.symbol[[ord(c) for c in letters]] = np.arange(len(letters))
        number = {c: i for i, c in enumerate(letters)}
        edges: dict[int, int] = {}
        self.width, ends = len(letters), {}
        for name, i in self.spelled.items():
            node = 0
            for c in name:
                node = edges.setdefault(node * self.width + number[c], len(edges) + 1)
            ends[node] = i
        keys, nodes = np.fromiter(edges.keys(), np.int64), np.fromiter(edges.values(), np.int64)
        order = np.argsort(keys)
        self.edges, self.nodes = keys[order], nodes[order]
        self.token = np.full(len(edges) + 1, -1, np.int64)
        self.token[list(ends)] = list(ends.values())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": None}

    def encoder(self) -> Encoder:
        """One for all tasks of a worker, so that what it keeps is made once."""
        if self.kept is None:
            self.kept = Encoder(self)
        return self.kept

    def spelling(self, name: str) -> str:
        """A token's symbols, one character each."""
        if not name.endswith(self.end) or name == self.end:
            return name
        body = name[: -len(self.end)]
        return body[:-1] + chr(ord(body[-1]) + LAST)

    def crossed(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge crosses the border of each pair of tokens; with ``below``, one of a lower rank than that."""
        out = np.zeros(len(a), bool)
        rows, x, x_ends = np.arange(len(a)), a, np.full(len(a), NEVER)
        while len(rows):  # symbols that end the left token, from itself down to its last letter
            own, y, y_ends = np.arange(len(rows)), b[rows], np.full(len(rows), NEVER)
            while len(own):
                key = x[own] * self.n + y
                at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                r = np.where(self.pairs[at] == key, self.rank[self.made[at]], NEVER)
                # of equal merges the first place goes first: before the right one's own, after the left one's own
                hit = (r < x_ends[own]) & (r <= y_ends) & (r < NEVER)
                if below is not None:
                    hit &= r < below[rows[own]]
                out[rows[own[hit]]] = True
                y_ends, y = self.rank[y], self.left[y]
                go = y >= 0
                own, y, y_ends = own[go], y[go], y_ends[go]
            x_ends, x = self.rank[x], self.right[x]
            go = (x >= 0) & ~out[rows]
            rows, x, x_ends = rows[go], x[go], x_ends[go]
        return out

    def propose(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left, of all words side by side: tokens in order, and the word of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        if (symbols < 0).any():
            raise ValueError("no token for a symbol")
        ends = np.cumsum(sizes)
        word, at, made = np.arange(len(words)), ends - sizes, []
        while len(word):
            alive, node, to = np.arange(len(word)), np.zeros(len(word), np.int64), at.copy()
            best, best_to = np.full(len(word), -1, np.int64), at.copy()
            while len(alive):
                key = node * self.width + symbols[to]
                place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                go = self.edges[place] == key
                alive, node, to = alive[go], self.nodes[place[go]], to[go] + 1
                token = self.token[node]
                some = token >= 0
                best[alive[some]], best_to[alive[some]] = token[some], to[some]
                more = to < ends[word[alive]]
                alive, node, to = alive[more], node[more], to[more]
            made.append((word, best))
            more = best_to < ends[word]
            word, at = word[more], best_to[more]
        owner = np.concatenate([w for w, _ in made])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([t for _, t in made])[order], owner[order]

    def proposed_long(self, word: str) -> list[int]:
        """The same for a single word of any length."""
        out, at, n, get = [], 0, len(word), self.spelled.get
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                i = get(word[at:to])
                if i is not None:
                    out.append(i)
                    at = to
                    break
            else:
                raise ValueError("no token for a symbol")
        return out

    def merged(self, word: str) -> list[int]:
        """The encoding by one merge after another: of lowest rank, then from the left."""
        ids, n = [self.spelled[c] for c in word], self.n
        if len(ids) > SHORT:
            return self.merged_long(ids)
        rank, makes, none = self.ranks.get, self.makes, len(self.makes)
        open_ranks = [rank(a * n + b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while open_ranks and (r := min(open_ranks)) < none:
            i = open_ranks.index(r)
            ids[i : i + 2] = [makes[r]]
            del open_ranks[i]
            if i:
                open_ranks[i - 1] = rank(ids[i - 1] * n + ids[i], none)
            if i < len(open_ranks):
                open_ranks[i] = rank(ids[i] * n + ids[i + 1], none)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap, for words of any length."""
        n, heap = len(ids), []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                r = self.ranks.get(ids[i] * self.n + ids[after[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i))

        for i in range(n):
            offer(i)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.ranks.get(ids[i] * self.n + ids[j]) != r:
                continue  # one of the two is merged already
            ids[i], ids[j] = self.makes[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encode_words(self, words: Sequence[str]) -> tuple[list[list[int]], int]:
        """Tokens of each word, in symbols, and how many words failed the check."""
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        out: list[list[int]] = [[]] * len(words)
        if short:
            tokens, owner = self.propose([words[k] for k in short])
            cuts = np.searchsorted(owner, np.arange(len(short) + 1)).tolist()
            ids = tokens.tolist()
            for k, a, b in zip(short, cuts[:-1], cuts[1:], strict=True):
                out[k] = ids[a:b]
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.proposed_long(w)
        flat = np.fromiter(itertools.chain.from_iterable(out), np.int64)
        owner = np.repeat(np.arange(len(out)), [len(x) for x in out])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        bad = self.crossed(pairs // self.n, pairs % self.n)
        failed = np.unique(owner[inner[bad[which]]])
        for k in failed.tolist():
            out[k] = self.merged(words[k])
        return out, len(failed)


class Lists:
    """Lists of ids by a text, all in one array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, names: Sequence[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(names, range(len(self.index), len(self.index) + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def over(self, most: int, most_ids: int) -> bool:
        return len(self.index) > most or len(self.flat) > most_ids

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at these places one after another, and where each ends."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], ends


class Encoder:
    """Encodes texts with a vocabulary, and keeps what it made of words and of runs without white space."""

    def __init__(self, vocab: Vocabulary, most_words: int = MOST_WORDS, most_runs: int = MOST_RUNS, most_ids: int = MOST_IDS):
        self.vocab, self.most_words, self.most_runs, self.most_ids = vocab, most_words, most_runs, most_ids
        rules = Tokenizer.from_str(vocab.rules)
        self.normalised, self.cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        declared = json.loads(vocab.rules)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        #: The declared cut, or the end of a run, for runs of printable ASCII: normalisation only puts them in lower case, and bytes spell them as themselves.
        self.plain = regex.compile(f"{declared}|\n")
        names = sorted(vocab.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.forget()

    def forget(self) -> None:
        """Starts with special tokens only."""
        self.words, self.runs = Lists(), Lists()
        special = self.vocab.special
        self.words.add([SPECIAL + name for name in special], np.array(list(special.values())), np.ones(len(special), np.int64))

    def pieces(self, run: str) -> list[str]:
        """Words of a run, as bytes spell them; special tokens, which are looked for before anything is normalised, are marked."""
        out = []
        for part in self.special.split(run) if self.special else [run]:
            if part in self.vocab.special:
                out.append(SPECIAL + part)
            elif part:
                out += [word for word, _ in self.cut(self.normalised(part)) if word]
        return out

    def learn(self, runs: list[str]) -> None:
        """Encodes new runs and keeps them."""
        easy = [r.isascii() and r.isprintable() and not (self.special and self.special.search(r)) for r in runs]
        names = list(itertools.compress(runs, easy))
        words = self.plain.findall("\n".join([*names, ""]).lower())
        for run in itertools.compress(runs, (not x for x in easy)):
            names.append(run)
            words += self.pieces(run)
            words.append("\n")
        marks = np.fromiter(map("\n".__eq__, words), bool, len(words))
        owner = np.cumsum(marks)[~marks]
        words = list(itertools.compress(words, ~marks))
        new = [w for w in dict.fromkeys(words) if w not in self.words.index]
        made, _ = self.vocab.encode_words([w[:-1] + chr(ord(w[-1]) + LAST) for w in new])
        sizes = np.array([len(x) for x in made], np.int64)
        self.words.add(new, np.fromiter(itertools.chain.from_iterable(made), np.int32), sizes)
        places = np.fromiter(map(self.words.index.__getitem__, words), np.int64, len(words))
        flat, _ = self.words.of(places)
        self.runs.add(names, flat, np.bincount(owner, self.words.sizes[places], minlength=len(names)).astype(np.int64))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        if self.words.over(self.most_words, self.most_ids):
            self.forget()
        if self.runs.over(self.most_runs, self.most_ids):  # made again from words without much work
            self.runs = Lists()
        found = [RUN.findall(t) if t else [] for t in texts]
        n = np.array([len(x) for x in found], np.int64)
        runs = list(itertools.chain.from_iterable(found))
        places = list(map(self.runs.index.get, runs))
        new = list(dict.fromkeys(itertools.compress(runs, [i is None for i in places])))
        if new:
            self.learn(new)
            places = list(map(self.runs.index.__getitem__, runs))
        ids, ends = self.runs.of(np.array(places, np.int64))
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary of a tokenizer's file, read by the driver; executors needn't have the file."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Vocabulary(f.read()))  # a few MB, by the file


def joined_names(names: pa.Array, ids: pa.Array) -> pa.Array:
    """The text of each list of ids: names joined by a space, without null ids and ids that have no name."""
    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten()
    good = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names)))
    taken = names.take(pc.if_else(good, flat, pa.scalar(None, flat.type)))
    before = np.concatenate([[0], np.cumsum(taken.is_valid().to_numpy(zero_copy_only=False))])
    offsets = before[np.concatenate([[0], np.cumsum(n)])]
    words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.drop_null().cast(pa.large_string()))
    return pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encoded(docs: DataFrame, vocab: Broadcast, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None, decoded: str | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with a column of token ids, an array of int; with ``decoded``, and one of the texts that these decode to, from the same pass.

    Null and empty texts have no ids; texts of any length count whole; the strings of special tokens become their ids
    and none are added; repeated rows are encoded each; an empty table gives an empty result. A column that has the
    name of one that is added is replaced; columns of other names stay.
    """
    added = [c for c in (ids, decoded) if c]
    own = without(docs, *(c for c in added if c.lower() != text.lower()))
    kept = [c for c in (own.columns if keep is None else keep) if c.lower() not in {a.lower() for a in added}]
    own = own.select(*(f"`{c}`" for c in kept), f"`{text}`")
    kinds = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*own.schema.fields[:-1], *kinds])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.value.encoder()
        names = pa.array(vocab.value.names, pa.string()) if decoded else None
        for batch in batches:
            bodies = batch.column(len(kept)).to_pylist()
            for part in chunks([len(x or "") for x in bodies]):
                flat, offsets = encoder.encode(bodies[part])
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                more = [joined_names(names, column)] if decoded else []
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(part.start, part.stop - part.start) for i in range(len(kept))), column, *more], names=schema.names)

    return own.transform(in_arrow, encode, schema)


def decoded(rows: DataFrame, vocab: Broadcast, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with a column of the texts that ids decode to: tokens' names, special ones too, joined by a space.

    Null or no ids give an empty text; null ids in a list, and ids without a token, are left out. A column that has
    the name of the text is replaced; columns of other names stay.
    """
    own = without(rows, text)
    at = own.columns.index(ids)
    schema = T.StructType([*own.schema.fields, T.StructField(text, T.StringType())])
    shared = rows.sparkSession.sparkContext.broadcast(vocab.value.names)  # without what encoding needs

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, joined_names(names, batch.column(at))], names=schema.names)

    return own.transform(in_arrow, decode, schema)
