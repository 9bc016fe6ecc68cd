"""Byte-pair encoding by dynamic programming over the prefixes of a word.

The last token of the encoding of a prefix is unique: it is the one vocabulary token that ends the
prefix and is compatible with the last token of what goes before it. So each prefix stores that one
token, found among the suffix matches of an automaton, and the ids are read off backwards.
"""

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F, types as T

from newsflow.llm.common import bounded_batches, cached, table

#: Steps of the automaton and token pairs a worker remembers before it starts anew, and bytes of
#: words, and of runs, with the objects that hold them.
REMEMBER, REMEMBER_BYTES, ENTRY_BYTES = 500_000, 96 << 20, 250
NEVER = 1 << 40
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()),
                       T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])


def _byte_letters():
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 256
    for byte in range(256):
        if byte in plain:
            letters[byte] = chr(byte)
        else:
            letters[byte], extra = chr(extra), extra + 1
    return letters


class Vocabulary:
    """A BPE vocabulary file with word ends: its merges, and a suffix automaton of all its tokens.

    A word is a string of symbols: one letter per byte, and the last one marked as word end by an
    offset of its code point.
    """

    WORD_END, MARK = "</w>", 0x1000

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._check(spec)
        self.ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: token for token, i in [*self.ids.items(), *self.special.items()]}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_split = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len)[::-1]) + ")")
        self.letters = _byte_letters()
        self.marked = {c: chr(ord(c) + self.MARK) for c in self.letters.values()}
        self.left, self.right, self.made = {}, {}, {}
        self.merged = {}
        for order, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.merged[left << 32 | right] = order
            if whole not in self.made:
                self.left[whole], self.right[whole], self.made[whole] = left, right, order
        self.pairs, self.steps = {}, {}
        tokens = {self.symbols(token): i for token, i in self.ids.items()}
        self.tokens = {s: i for s, i in tokens.items() if i in self.made or len(s) == 1}
        self.begins = {s[:n] for s in self.tokens for n in range(1, len(s) + 1)}
        # Tokens that no text is encoded to must not end a prefix.
        self.tokens = {s: i for s, i in self.tokens.items() if self.encode(s) == [i]}
        self.steps.clear()

    def _check(self, spec):
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if (model["type"], model["end_of_word_suffix"], steps, spec["decoder"]) != (
                "BPE", self.WORD_END, ["NFC", "Replace", "Lowercase"], None):
            raise ValueError("not a lower-casing BPE vocabulary with word ends")

    def symbols(self, token):
        """A token of the file as symbols."""
        if token.endswith(self.WORD_END) and token != self.WORD_END:
            body = token[:-len(self.WORD_END)]
            return body[:-1] + chr(ord(body[-1]) + self.MARK)
        return token

    def word(self, text):
        """A word of a text as symbols."""
        if not text.isascii() or not text.isprintable():
            text = "".join([self.letters[byte] for byte in text.encode()])
        return text[:-1] + self.marked[text[-1]]

    def compatible(self, a, b):
        """Whether tokens a and b, one after the other, stay apart while merges are applied.

        Goes back in time: ``a`` and ``b`` are the parts that touch, each until the merge that
        takes it into its whole token. They would merge if theirs came first; of equal merges the
        left one comes first.
        """
        made, merged = self.made, self.merged
        until_a = until_b = NEVER
        while True:
            order = merged.get(a << 32 | b)
            if order is not None and order < until_a and order <= until_b:
                return False
            made_a, made_b = made.get(a, -1), made.get(b, -1)
            if made_a > made_b:
                until_a, a = made_a, self.right[a]
            elif made_b >= 0:
                until_b, b = made_b, self.left[b]
            else:
                return True

    def step(self, read):
        """The automaton's next state and the tokens that end there, longest first.

        A state is the longest suffix of what was read that a token begins with; ``read`` is a
        state and one more symbol. Steps are worked out when first taken.
        """
        state = read
        while state and state not in self.begins:
            state = state[1:]
        ends = [(self.tokens[state[i:]], len(state) - i)
                for i in range(len(state)) if state[i:] in self.tokens]
        if len(self.steps) > REMEMBER:
            self.steps.clear()
        found = self.steps[read] = (state, ends)
        return found

    def encode(self, symbols):
        """Ids of one word."""
        steps, pairs, state, end = self.steps, self.pairs, "", 0
        last, size = [-1], [0]  # of each prefix: its last token and that one's length
        for symbol in symbols:
            end += 1
            step = steps.get(state + symbol) or self.step(state + symbol)
            state, matches = step
            for token, length in matches:
                if length == end:
                    break
                key = last[end - length] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > 2 * REMEMBER:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(key >> 32, token)
                if fits:
                    break
            last.append(token)
            size.append(length)
        ids = []
        while end:
            ids.append(last[end])
            end -= size[end]
        return ids[::-1]


def _held(text, found):
    """Bytes that an entry of a cache takes, about."""
    return ENTRY_BYTES + 2 * (len(text) + len(found[1]) + len(found[2]))


class Words(dict):
    """Encoded words by their text, and encoded runs without white space, made when asked for.

    A value is (number of tokens, ids joined by blanks, tokens joined by blanks).
    """

    def __init__(self, vocabulary):
        self.vocabulary, self.words = vocabulary, {}
        self.size = self.words_size = 0

    def one(self, word):
        found = self.words.get(word)
        if found is None:
            if self.words_size > REMEMBER_BYTES:
                self.words.clear()
                self.words_size = 0
            ids = self.vocabulary.encode(self.vocabulary.word(word))
            names = self.vocabulary.names
            found = self.words[word] = (len(ids), " ".join(map(str, ids)),
                                        " ".join([names[i] for i in ids]))
            self.words_size += _held(word, found)
        return found

    def run(self, text):
        """Encoding of a text without special tokens, by its words."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        words = self.vocabulary.split.findall(text.lower())
        if len(words) == 1:
            return self.one(words[0])
        found = [self.one(word) for word in words]
        return (sum(f[0] for f in found), " ".join([f[1] for f in found]),
                " ".join([f[2] for f in found]))

    def __missing__(self, text):
        found = self.run(text)
        if self.size > REMEMBER_BYTES:
            self.clear()
            self.size = 0
        self[text] = found
        self.size += _held(text, found)
        return found


def encode_text(text, runs):
    """Encoded parts of a text in order; white space only separates them."""
    parts = []
    for i, piece in enumerate(runs.vocabulary.special_split.split(text)):
        if i % 2:
            parts.append((1, str(runs.vocabulary.special[piece]), piece))
        elif any(c in piece for c in "\x1c\x1d\x1e\x1f"):  # white space to split(), not here
            parts.append(runs.run(piece))
        else:
            parts += map(runs.__getitem__, piece.split())
    return [part for part in parts if part[0]]


def encodings(path):
    return cached(("bpe", path), lambda: Words(Vocabulary(path)), large=True)


def bpe_digest(text: Column, path: str) -> Column:
    """Number of tokens, digest of the ids, and digest of the text decoded from them.

    Null counts as empty: no tokens, and the digests of the empty string. A text may be of any
    length; what a worker remembers is bounded in bytes.
    """
    @F.arrow_udf(RESULT)
    def digest(texts: pa.Array) -> pa.Array:
        runs, rows = encodings(path), []
        for text in texts:
            parts = encode_text(text.as_py() or "", runs)
            ids, decoded = (" ".join([p[i] for p in parts]) for i in (1, 2))
            rows.append((sum(p[0] for p in parts), hashlib.sha256(ids.encode()).hexdigest(),
                         hashlib.sha256(decoded.encode()).hexdigest()))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
             pa.array(columns[2], pa.string())], RESULT.names)

    return digest.asNondeterministic()(text)


def bpe_ids(text: Column, path: str) -> Column:
    """Array of token ids; empty for null."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        runs = encodings(path)
        rows = [" ".join([p[1] for p in encode_text(text.as_py() or "", runs)]).split()
                for text in texts]
        return pa.array([np.array(row, np.int32) for row in rows], pa.list_(pa.int32()))

    return ids(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """The tokens of the ids with blanks between them, as a vocabulary without a decoder gives;
    null stays null, ids outside the vocabulary are left out."""
    @F.arrow_udf(T.StringType())
    def decode(rows: pa.Array) -> pa.Array:
        names = encodings(path).vocabulary.names
        return pa.array([None if row is None else " ".join(names[i] for i in row if i in names)
                         for row in rows.to_pylist()], pa.string())

    return decode(ids)


def op2_bpe(spark, sf_dir):
    import public_tokenizers

    bounded_batches(spark)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return (table(spark, sf_dir, "documents")
            .select("doc_id", bpe_digest(F.col("text"), path).alias("_e"))
            .select("doc_id", *[F.col(f"_e.{name}") for name in RESULT.names]))
