"""Rows every operator must take."""

#: Texts every operator must take: null, empty, white space, one word, repeats, odd characters, a very long word and text.
ODD = [
    None, "", " ", " \t\n\x0b\x0c\r ", "one", "one", "One  two", "a b c d e f g", "a b c d e f g", "ñandú 日本語 é́ \U0001f600",
    "<|endoftext|> a<|startoftext|>", "x" * 50_000, "w " * 30_000, "line\n" * 300 + "end", "\x00\x01 \x00 b", "tab\tnew\nline  two ",
]
