"""Question frames: short token grammars with one open slot.

A frame is a line of steps. A step is a word, words apart by |, a word class in angle brackets, or _ for the slot: one
to SLOT_WORDS words that the following step ends. A frame may begin anywhere in a question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

SLOT_WORDS = 6
CLASSES = {
    "be": "is are was were",
    "do": "do does did",
    "own": "have has had",
    "of": "of for on in",
    "with": "in with from by",
    "measure": "long much heavy big old tall wide far deep",
    "handle": "store stores manage manages supply supplies handle handles deliver delivers ship ships stock stocks sell sells make makes own owns",
}


@dataclass(frozen=True)
class Frame:
    """Steps as sets of words; None is the slot."""

    steps: tuple[frozenset[str] | None, ...]

    @classmethod
    def parse(cls, line: str) -> Frame:
        steps: list[frozenset[str] | None] = []
        for step in line.split():
            if step == "_":
                steps.append(None)
                continue
            words: set[str] = set()
            for part in step.split("|"):
                words |= set(CLASSES[part[1:-1]].split()) if part[0] == "<" else {part}
            steps.append(frozenset(words))
        return cls(tuple(steps))

    def slots(self, words: list[str]) -> Iterator[list[str]]:
        """What fills the slot, for each place where the frame fits."""
        for start in range(len(words)):
            if (found := self._from(words, start)) is not None:
                yield found

    def _from(self, words: list[str], at: int) -> list[str] | None:
        for k, step in enumerate(self.steps):
            if step is None:
                stop = self.steps[k + 1]
                for end in range(at + 1, min(at + SLOT_WORDS, len(words) - 1) + 1):
                    if words[end] in stop and self._rest(words, end, k + 1):
                        return words[at:end]
                return None
            if at >= len(words) or words[at] not in step:
                return None
            at += 1
        return None

    def _rest(self, words: list[str], at: int, k: int) -> bool:
        return len(words) - at >= len(self.steps) - k and all(w in s for w, s in zip(words[at:], self.steps[k:]))


#: Who asks for an attribute, and who counts or names an entity.
ATTRIBUTE = tuple(map(Frame.parse, ("what|which <be> the _ <of>", "how <measure> <be> the _ <of>", "in which _ <be>", "which _ does|did")))
ENTITY = tuple(map(Frame.parse, ("how many _ <be>|<do>|<own>|<with>|<handle>", "which _ <handle>")))


def asked(frames: tuple[Frame, ...], words: list[str]) -> list[list[str]]:
    """The slots that frames fill in a question, each once."""
    return list(map(list, dict.fromkeys(tuple(s) for f in frames for s in f.slots(words))))
