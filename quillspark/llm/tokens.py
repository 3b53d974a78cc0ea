"""Token ids of whole texts by a public tokenizer, with a bounded memory of pieces already encoded.

A text is cut at single spaces, or at any white space where the tokenizer drops it. Neither tokenizer joins what stands left and right of
a space before a character that is not white space, so the ids of a text are those of its pieces in a row (tests compare with whole texts). Punctuation
behind a piece is cut off where the tokenizer itself shows that it never joins the character before it. Pieces repeat; each
is encoded once while it is remembered, and those met least are forgotten first. Many new pieces go through the tokenizer in one call: as running text where
its tokens tell the pieces apart (a byte-level token that begins with a space begins a piece; a token that ends a word ends a piece of letters), else parted by its own special token.

A special token's string in a text gets its own id, as the library gives it by default; `special_text` reads it as ordinary text.
"""

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.arrays import text_buffer

MOST_PIECES = 1_200_000  # some 300 MB of a worker
_PUNCTUATION = ".,;:!?"
_NOT_WHITE = "\x1c\x1d\x1e\x1f"  # white space to str.split() alone
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_CALL = 4096  # pieces in one call
_encoders = {}


def encoder(path, spaced, most=MOST_PIECES, special_text=False):
    """The worker's encoder for a tokenizer file. spaced: a leading space is part of a piece (byte-level BPE); most: pieces to remember."""
    key = path, spaced, most, special_text
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Encoder:
    def __init__(self, path, spaced, most=MOST_PIECES, special_text=False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.parted, self.spaced, self.most = Tokenizer.from_file(path), spaced, most
        self.plain = self.parted
        if special_text:  # its marks must stay special where pieces are parted
            self.plain = Tokenizer.from_file(path)
            self.plain.encode_special_tokens = True
        special = {t.content: i for i, t in self.plain.get_added_tokens_decoder().items()}
        self.mark = sorted(special)[0]
        self.mark_id = special[self.mark]
        edge = [(t.startswith("\u0120") if spaced else t.endswith("</w>"), i) for t, i in self.plain.get_vocab().items()]
        self.edge = np.zeros(max(i for _, i in edge) + 1, bool)
        self.edge[[i for at_edge, i in edge if at_edge]] = True
        normal = self.plain.normalizer
        self._normal = normal.normalize_str if normal else str
        self._small = self._normal("A") == "a"
        self._letters, self._ends = set(), {}
        self._forget()

    def _forget(self):
        self.codes, self.new = {}, []
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.bad, self.met = (np.zeros(1 << 16, t) for t in (np.int64, np.int64, bool, np.int64))

    def _forget_rare(self):
        """Keep the pieces met more than once, of too many the half met most. What was met long ago counts half."""
        n = len(self.codes)
        met = self.met[:n]
        keep = met > 1
        if keep.sum() > self.most // 2:
            keep = met > np.partition(met, n - self.most // 2 - 1)[n - self.most // 2 - 1]
        self.met = met // 2
        at = np.cumsum(keep) - 1
        self.codes = {piece: int(at[code]) for piece, code in self.codes.items() if keep[code]}
        length = self.length[:n][keep]
        pool = _gathered(self.pool, self.start[:n][keep], length)
        self.pool, self.used = _room(pool, len(pool) + 1), len(pool)
        self.start, self.length = _room(np.cumsum(length) - length, 1 << 16), _room(length, 1 << 16)
        self.bad, self.met = _room(self.bad[:n][keep], 1 << 16), _room(self.met[:n][keep], 1 << 16)

    def _is_letter(self, char):
        if self._normal(char).isalpha():
            self._letters.add(char)
            return True
        return False

    def _is_end(self, char):
        """Whether punctuation behind this character is always a part of its own."""
        found = self._ends.get(char)
        if found is None:
            ids = lambda text: self.plain.encode(text, add_special_tokens=False).ids
            found = char.isalnum() and all(ids(f" {x}{char}{p}") == ids(f" {x}{char}") + ids(p) for p in _PUNCTUATION for x in ("", "a", "1"))
            self._ends[char] = found
        return found

    def _runs_on(self, segment):
        """Whether the segment can stand in running text, its edges told by the tokens."""
        if self.spaced:
            return len(segment) > 1 and segment[0] == " " and not segment[1].isspace() and " " not in segment[1:]
        return segment.isalpha() and (segment.isascii() or self._letters.issuperset(segment) or all(map(self._is_letter, segment)))

    def _ids(self, text):
        return np.array(self.parted.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _running(self, segments):
        """Ids and lengths of segments in running text."""
        ids = self._ids("".join(segments) if self.spaced else " ".join(segments))
        cuts = np.flatnonzero(self.edge[ids])
        if len(cuts) != len(segments):
            return self._parted(segments)
        return ids, np.diff(np.append(cuts, len(ids)) if self.spaced else np.append(-1, cuts))

    def _parted(self, segments):
        """Ids and lengths of segments parted by marks: one before each, so that none is lost when it is empty."""
        ids = self._ids(self.mark + self.mark.join(segments))
        cuts = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, cuts), np.diff(np.append(cuts, len(ids))) - 1

    def _segments(self, segments):
        """Ids of all segments, with starts and lengths."""
        kinds = [0 if "<" in s else 1 if self._runs_on(s) else 2 for s in segments]  # 0: may hold a special token's string
        starts, lengths, flat, base = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64), [np.zeros(0, np.uint32)], 0
        kinds = np.array(kinds, np.int8)
        for kind, size in ((0, 1), (1, _CALL), (2, _CALL)):
            rows = np.flatnonzero(kinds == kind)
            for i in range(0, len(rows), size):
                some = rows[i : i + size]
                if kind:
                    ids, n = (self._running if kind == 1 else self._parted)([segments[j] for j in some.tolist()])
                else:
                    ids = np.array(self.plain.encode(segments[some[0]], add_special_tokens=False).ids, np.uint32)
                    n = np.array([len(ids)])
                lengths[some], starts[some] = n, base + np.cumsum(n) - n
                flat.append(ids)
                base += len(ids)
        return np.concatenate(flat), starts, lengths

    def _ids_of_parts(self, parts):
        """Ids of all parts in a row, and how many each has."""
        ids, starts, lengths = self._segments(parts)
        return _gathered(ids, starts, lengths), lengths

    def _ids_of_pieces(self, pieces):
        """The same of pieces with their space, punctuation behind them apart."""
        cores, tails, where = [], [], {"": 0}
        for piece in pieces:
            head = piece.__class__ is tuple
            body = piece[0] if head else piece
            core, tail = body.rstrip(_PUNCTUATION), ""
            if len(core) < len(body):
                if core and (core[-1].isascii() and core[-1].isalnum() or self._is_end(core[-1])):
                    tail = body[len(core) :]
                else:
                    core = body
            cores.append(where.setdefault(core if head else " " + core, len(where)))
            tails.append(where.setdefault(tail, len(where)))
        ids, starts, lengths = self._segments(list(where))
        both = np.column_stack([cores, tails]).ravel()
        return _gathered(ids, starts[both], lengths[both]), lengths[cores] + lengths[tails]

    def _learn(self):
        new, self.new = self.new, []
        if not new:
            return
        first, n = len(self.codes) - len(new), len(self.codes)
        flat, lengths = (self._ids_of_pieces if self.spaced else self._ids_of_parts)(new)
        self.pool = _room(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start, self.length, self.bad, self.met = (_room(x, n) for x in (self.start, self.length, self.bad, self.met))
        self.start[first:n] = self.used + np.cumsum(lengths) - lengths
        self.length[first:n] = lengths
        self.bad[first:n] = self.spaced and [p.__class__ is str and (not p or p[0].isspace()) for p in new]
        self.met[first:n] = 0
        self.used += len(flat)

    def _coded(self, pieces):
        codes = self.codes
        out = np.fromiter(map(codes.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        for i in np.flatnonzero(out < 0).tolist():
            piece = pieces[i]
            code = codes.get(piece)
            if code is None:
                codes[piece] = code = len(codes)
                self.new.append(piece)
            out[i] = code
        return out

    def _parts(self, words):
        """Words cut into what stands before the punctuation behind them, in small letters where that is the same, and the punctuation."""
        data, offsets = text_buffer(words)
        core, whole = pc.utf8_rtrim(words, characters=_PUNCTUATION), np.diff(offsets)
        size = pc.binary_length(core).to_numpy()
        cut = (size < whole) & (size > 0)
        rows = np.flatnonzero(cut)
        last = data[offsets[rows] + size[rows] - 1]
        cut[rows] = _ALNUM[last]
        for i in rows[last >= 128].tolist():
            cut[i] = self._is_end(core[i].as_py()[-1])
        core, size = pc.if_else(pa.array(cut), core, words), np.where(cut, size, whole)
        ends = np.append(0, np.cumsum(whole - size)).astype(np.int32)
        tails = _gathered(data, offsets[:-1] + size, whole - size)
        tail = pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(tails))
        if self._small:
            plain = pc.and_not(pc.string_is_ascii(core), pc.match_substring(core, "<"))
            core = pc.if_else(plain, pc.ascii_lower(core), core)
        return core, tail

    def _word_ids(self, texts):
        """Ids of all words in a row, how many each word has, and how many words each text. Of equal words one is looked up."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        data, _ = text_buffer(texts)
        if ((data >= ord(_NOT_WHITE[0])) & (data <= ord(_NOT_WHITE[-1]))).any():
            words = [t.split(" ") if any(c in t for c in _NOT_WHITE) else t.split() for t in texts.to_pylist()]
            words = pa.array(words, pa.list_(pa.string()))
        else:
            words = pc.utf8_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        at, codes = each.indices.to_numpy(), []
        for part in self._parts(each.dictionary):
            part = part.dictionary_encode()
            codes.append(self._coded(part.dictionary.to_numpy(zero_copy_only=False).tolist())[part.indices.to_numpy()])
        self._learn()
        n = len(self.codes)
        self.met[:n] += np.bincount(codes[0], np.bincount(at, minlength=len(codes[0])), n).astype(np.int64)
        self.met[codes[1]] += 1
        both = np.column_stack(codes)
        lengths = self.length[both]
        ids = _gathered(self.pool, self.start[both.ravel()], lengths.ravel())
        lengths = lengths.sum(1)
        starts = np.cumsum(lengths) - lengths
        return _gathered(ids, starts[at], lengths[at]), lengths[at], pc.list_value_length(words).to_numpy()

    def _piece_ids(self, texts):
        """The same for pieces with their space. The first piece of a text has none before it."""
        pieces = [t.split(" ") for t in texts]
        for p in pieces:
            p[0] = (p[0],)
        coded = [self._coded(p) for p in pieces]
        self._learn()
        rejoined = [i for i, c in enumerate(coded) if self.bad[c].any()]
        for i in rejoined:
            coded[i] = self._coded(_rejoined(pieces[i], self.bad[coded[i]]))
        self._learn()
        codes = np.concatenate([np.zeros(0, np.int64), *coded])
        self.met[: len(self.codes)] += np.bincount(codes, minlength=len(self.codes))
        lengths = self.length[codes]
        return _gathered(self.pool, self.start[codes], lengths), lengths, [len(c) for c in coded]

    def encode(self, texts, end_id):
        """All ids of all texts (a list, or an Arrow column), each text followed by `end_id`, and the n + 1 bounds between texts."""
        if len(self.codes) > self.most:
            self._forget_rare()
        ids, lengths, counts = (self._piece_ids if self.spaced else self._word_ids)(texts)
        last = np.cumsum(counts, dtype=np.int64)
        stops = np.concatenate([[0], np.cumsum(lengths)])[last]
        return np.insert(ids, stops, end_id), np.concatenate([[0], stops + np.arange(1, len(texts) + 1)])


def _gathered(ids, starts, lengths):
    """The spans of `ids`, in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _room(array, n):
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def _rejoined(pieces, bad):
    """Pieces before which the text must not be cut are put back behind the piece before them."""
    out = [pieces[0][0]]
    for piece, stays in zip(pieces[1:], bad[1:]):
        if stays:
            out[-1] += " " + piece
        else:
            out.append(piece)
    return [(out[0],), *out[1:]]
