"""Cut texts where tokenization cannot cross, so that equal pieces are encoded once."""

from __future__ import annotations


def cut(text: str) -> list[str]:
    """Parts whose tokens, joined, are the text's, under the public split patterns.

    Where every space stands alone between other characters and is a blank or a line feed, a blank belongs to what follows
    and a line feed is a match of its own; so the text may be cut before each blank and around each line feed. Any other
    text stays whole.
    """
    words = text.split()
    gaps = len(words) - 1
    if gaps < 1 or len(text) - sum(map(len, words)) != gaps or text.count(" ") + text.count("\n") != gaps or "\0" in text:
        return [text] if text else []
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
