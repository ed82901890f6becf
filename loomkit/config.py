"""Label sets and the orders that break ties."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LabelSet:
    """The classes of a task. default is the majority class, the others are minority classes.

    pooled breaks ties of unions that pool votes of all classes, by_class of those with a threshold for each class.
    """

    labels: tuple[str, ...]
    default: str
    pooled: tuple[str, ...]
    by_class: tuple[str, ...]

    @property
    def minority(self) -> tuple[str, ...]:
        return tuple(x for x in self.labels if x != self.default)


#: The five classes of the sentence task and its two orders.
SENTENCES = LabelSet(
    labels=("Supported", "Unsupported Causal Mechanistic", "Unsupported Entity", "Scope Overgeneralization", "Contradiction"),
    default="Supported",
    pooled=("Contradiction", "Scope Overgeneralization", "Unsupported Causal Mechanistic", "Unsupported Entity"),
    by_class=("Contradiction", "Unsupported Causal Mechanistic", "Unsupported Entity", "Scope Overgeneralization"),
)
#: What a hit on each class is worth as a reward, and the reward of unusable output.
REWARDS = {"Supported": 1.0, "Unsupported Causal Mechanistic": 5.0, "Contradiction": 4.5, "Unsupported Entity": 4.0, "Scope Overgeneralization": 3.5}
FORMAT_FAILURE = -1.0
#: The lengths of groups that reports tell apart.
LENGTH_BINS = ((2, 5), (6, 7), (8, 9), (10, 13), (14, None))
