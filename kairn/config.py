"""Options of a clustering run."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """rlim: match radius (a distance has to be under it). The rest decides probe order, bounds and limits."""

    rlim: float = 0.0
    auto_factor: float = 0.0
    dprob: float = 0.01
    maxcl: int = 1000
    maxcl_strategy: str = "stop"
    discard_frac: float = 0.5
    maxim: int = 100_000
    tm: float = 0.0
    te4: bool = False
    te5: bool = False
    gprob: bool = False
    fmatcha: float = 2.0
    fmatchb: float = 0.5
    maxvis: int = 1000
    pred: tuple[int, int, int] | None = None
    predf: tuple[int, int, int] | None = None
    entropy: bool = False
    entropy_max_targets: int = 15
    entropy_min_prob: float = 0.001
    entropy_gate: float = 2.0
    entropy_first_gate: float = 4.0
    entropy_fast: bool = False
    entropy_leader: bool = False
    entropy_leader_cutoff: float = 0.5
    soft_bayesian: bool = False
    soft_bayesian_sigma: float = 1.0
    sparse_dcc: bool = False
    sparse_dcc_extra_evals: int = 0
    tiles: str | None = None
    pass2: bool = False
    xtile: int = 0
    xtile_decay: float = 1.0
    retrieval_window: int = 1000
    unlimited: bool = False
    trace: bool = False
    trace_rows: int = 100

    def __post_init__(self) -> None:
        if self.rlim < 0 or self.maxcl < 1 or self.retrieval_window < 1:
            raise ValueError("rlim has to be at least 0, maxcl and retrieval_window at least 1")
        if self.maxcl_strategy not in ("stop", "discard", "merge"):
            raise ValueError(f"unknown strategy {self.maxcl_strategy!r}")
        if not 0 <= self.tm <= 1:
            raise ValueError("tm has to be in [0, 1]")

    @classmethod
    def parse(cls, words: Sequence[str]) -> EngineConfig:
        """From option words: `name value`, `name` for flags, dashes optional; `0.5` or `a1.5` alone is the
        radius, or a factor of the median distance. Unknown names raise."""
        kinds = {f.name: str(f.type) for f in fields(cls)}
        words, got = list(words), {}
        while words:
            word = words.pop(0)
            if re.fullmatch(r"[0-9.]+([eE]-?\d+)?", word):
                got["rlim"] = float(word)
                continue
            if m := re.fullmatch(r"a([0-9.]+)", word):
                got["auto_factor"] = float(m[1])
                continue
            name = word.lstrip("-").replace("-", "_")
            name = {"jtf": "pass2"}.get(name, name)
            if m := re.fullmatch(r"(predf?)(?:\[(\d+),(\d+),(\d+)\])?", name):
                got[m[1]] = (int(m[2]), int(m[3]), int(m[4])) if m[2] else (10, 1000, 2)
            elif name in ("no_pass2", "no_xtile"):
                got[name[3:]] = False if name == "no_pass2" else 0
            elif name not in kinds:
                raise ValueError(f"unknown option {word!r}")
            elif kinds[name] == "bool":
                got[name] = words.pop(0).lower() in ("1", "true") if words and words[0].lower() in ("0", "1", "true", "false") else True
            elif name == "xtile":
                got[name] = int(words.pop(0)) if words and words[0] in ("0", "1", "2") else 2
            elif name == "rlim" and words and (m := re.fullmatch(r"a([0-9.]+)", words[0])):
                words.pop(0)
                got["auto_factor"] = float(m[1])
            elif words:
                value = words.pop(0)
                got[name] = int(value) if kinds[name] == "int" else float(value) if kinds[name] == "float" else value
            else:
                raise ValueError(f"option {word!r} needs a value")
        return cls(**got)

    @classmethod
    def from_file(cls, path: str) -> EngineConfig:
        """From a file of `name [value]` lines; # starts a comment."""
        with open(path) as f:
            return cls.parse([w for line in f for w in line.split("#")[0].split()])

    def to_file(self, path: str) -> None:
        """Write all options that differ from their defaults."""
        default = asdict(EngineConfig())
        with open(path, "w") as f:
            for name, value in asdict(self).items():
                if value != default[name]:
                    text = f"{name}[{','.join(map(str, value))}]" if name in ("pred", "predf") else name if value is True else f"{name} {value}"
                    f.write(text + "\n")

    def with_radius(self, rlim: float) -> EngineConfig:
        return replace(self, rlim=rlim, auto_factor=0.0)
