"""A bounded memo for work on chunks of text, and how texts are cut into chunks that can be encoded one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memo:
    """key -> value for the keys lately used: two generations of at most ``size`` keys; a full one replaces the older.

    Bounds a Python worker's memory on any input; what is forgotten is worked out again, so results don't depend on it.
    """

    def __init__(self, make: Callable[[list], Iterable], size: int = 400_000):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def need(self, keys: Iterable) -> dict:
        """A dict that holds all these keys (of one text or batch), made in one call where missing."""
        young, old = self.young, self.old
        missing = [k for k in set(keys) if k not in young]
        if missing:
            fresh = [k for k in missing if k not in old]
            for k in missing:
                if k in old:
                    young[k] = old[k]
            young.update(zip(fresh, self.make(fresh)))
        return young

    def values(self, keys: list) -> list:
        """The values of keys in order (no value is None)."""
        found = list(map(self.young.get, keys))
        if None in found:
            known = self.need([k for k, x in zip(keys, found) if x is None])
            found = [known[k] for k in keys]
        return found

    def distinct(self, keys: list, longest: int) -> list:
        """The values of keys, all different, in order (no value is None); keys of more than ``longest`` letters aren't kept."""
        young, old, fresh = self.young, self.old, []
        found = list(map(young.get, keys))
        for i, x in enumerate(found):
            if x is None:
                k = keys[i]
                x = old.get(k)
                if x is None:
                    fresh.append(i)
                else:
                    young[k] = found[i] = x
        for i, x in zip(fresh, self.make([keys[i] for i in fresh])):
            found[i] = x
            if len(keys[i]) <= longest:
                young[keys[i]] = x
        return found

    def trim(self) -> None:
        """Call between batches."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


def marked_chunks(text: str) -> list[str]:
    """A text in SentencePiece's form, cut where no piece crosses: the marker stands for a space, one is put in front, and a
    chunk is a run of markers with what follows it, a line feed, or the rest of a line. Joined, the chunks are the form.

    Right for models whose pieces hold markers only at their start and no line feed in a longer piece (see ``cuttable``).
    """
    text = text.replace("▁", " ")
    if text[:1] != " " and "  " not in text and "\0" not in text:  # all at once; most texts are so
        out = ("▁" + text.replace(" ", "\0▁").replace("\n", "\0\n\0")).split("\0")
        return [c for c in out if c] if "" in out else out
    out: list[str] = []
    run = ""
    for part in text.split(" "):
        run += "▁"
        if part:
            if "\n" in part:
                lines = part.split("\n")
                out.append(run + lines[0])
                for line in lines[1:]:
                    out.append("\n")
                    if line:
                        out.append(line)
            else:
                out.append(run + part)
            run = ""
    if run:
        out.append(run)
    return out


def cuttable(pieces: Iterable[str]) -> bool:
    """Whether marked_chunks is right for these pieces."""
    return not any("\n" in p and len(p) > 1 or "▁" in p.lstrip("▁") for p in pieces)
