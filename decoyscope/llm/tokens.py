"""Token ids of whole texts, with the words' ids kept in each worker."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from decoyscope.llm.common import keeps

#: Words whose ids a Python worker keeps; words met after that are encoded again in each batch.
KEPT = 800_000


#: Words of Latin letters: one composed character each, whose lower case is one character too.
_LATIN = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿ]+")
_MARKS = b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"


def _byte_characters() -> dict[int, int]:
    """Byte -> character by which a byte-level vocabulary spells it: printable Latin-1 stands for itself, others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: 0x100 + i for i, b in enumerate(others)}


_BYTES = _byte_characters()


def _parts(word: bytes) -> tuple[bytes, ...]:
    """A word in lower case (ASCII) as what it ends with of marks, and the rest, if that ends with a Latin letter.

    The tokenizer lower-cases and never joins letters with other characters,
    so the word's ids are its parts' ids. Words with a < might hold a special
    string and stay whole.
    """
    if b"<" in word:
        return (word,)
    word = word.lower()
    stem = word.rstrip(_MARKS)
    if stem and len(stem) < len(word) and _LATIN.fullmatch(stem.decode("utf-8", "surrogatepass")[-1]):
        return (stem, word[len(stem) :])
    return (word,)


class WordIds:
    """Token ids of the white-space separated words of texts, as packed uint32.

    For a tokenizer whose pre-tokenizer drops white space and never joins
    across it, the ids of a text are the ids of its words in order. Special
    strings hold no white space, so the library also finds them in words.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.kept: dict[bytes, bytes] = {}
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        apart = [plain(w) for w in ("The", "cat's", "42", "ñandú,", "über-x")]
        if any(plain(white.join(("The", "cat's", "42", "ñandú,", "über-x"))) != sum(apart, []) for white in (" ", "  ", "\n", "\t \r\n")):
            raise ValueError(f"{name} keeps white space or joins across it: its ids aren't those of its words")
        # words of letters need no pre-tokenizer: the model takes them as they are spelt, if it spells as we do
        probe = "Straßeàñâÿí"
        spelt = [t.id for t in self.tokenizer.model.tokenize(probe.lower().encode().decode("latin-1").translate(_BYTES))]
        self.byte_level = spelt == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words, put together of stem and tail ids where these are known or shared."""
        parts = [_parts(w) for w in words]
        new = {p for ps in parts for p in ps if p not in self.kept}
        ids, rest = {}, []
        tokenize = self.tokenizer.model.tokenize
        for w in new:
            text = w.decode("utf-8", "surrogatepass")
            if self.byte_level and _LATIN.fullmatch(text):
                found = [t.id for t in tokenize(text.lower().encode().decode("latin-1").translate(_BYTES))]
                ids[w] = array("I", found).tobytes()
            else:
                rest.append(w)
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in rest], add_special_tokens=False)
        ids |= {w: array("I", e.ids).tobytes() for w, e in zip(rest, encoded)}
        one = lambda p: ids[p] if p in ids else self.kept[p]
        made = {w: one(ps[0]) if len(ps) == 1 else one(ps[0]) + one(ps[1]) for w, ps in zip(words, parts)}
        if len(self.kept) + len(made) + len(ids) <= KEPT:
            self.kept.update(ids)
            self.kept.update(made)
        return made

    def texts(self, texts: list[str | None]) -> list[bytes]:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        found = [list(map(self.kept.get, ws)) for ws in words]
        missing: set[bytes] = set()
        for ws, ids in zip(words, found):
            if None in ids:
                missing.update(w for w, i in zip(ws, ids) if i is None)
        fresh = self._encode(list(missing))
        return [b"".join(fresh[w] if i is None else i for w, i in zip(ws, ids)) if None in ids else b"".join(ids) for ws, ids in zip(words, found)]


@lru_cache(maxsize=4)
def word_ids(name: str) -> WordIds:
    """One for each tokenizer and Python worker."""
    import gc
    import os

    gc.set_threshold(1_000_000, 50, 1000)  # the kept words are no garbage, and many objects of theirs are made
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(name)


keeps("tokens", word_ids.cache_clear)
