"""Tokenizers from files, as callables that labels take: a text's ids and their places."""

from __future__ import annotations

from functools import lru_cache

#: A text that a faithful tokenizer gives back as it was.
PROBE = "Two  spaces, a\nline, é, 漢 and 'quotes'."


@lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class FileTokenizer:
    """A tokenizer file, loaded once by each Python worker; only its path travels."""

    def __init__(self, path: str, faithful: bool = True):
        """``faithful``: fail at once if texts don't come back from their ids as they were."""
        self.path = path
        if faithful and self.text(self(PROBE)[0]) != PROBE:
            raise ValueError(f"{path}: texts don't come back from their ids")

    def __call__(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = _load(self.path).encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    def text(self, ids: list[int]) -> str:
        return _load(self.path).decode(list(map(int, ids)), skip_special_tokens=False)
