"""The machine of holds as one table, for streams; debounce tells the same by windows."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DebounceConfig:
    min_hold_ms: int = 100
    blank_ms: int = 250
    switch_ms: int = 60
    min_hold_frames: int = 3
    min_blank_frames: int = 2


#: What is held, since when, in how many readings, and whether it was committed; what contradicts it, since when, how often.
FIELDS = ("cur", "start", "n", "done", "pk", "ps", "pn")
_UNDISPUTED = {"pk": "nothing", "ps": "nothing", "pn": "zero"}
_DISPUTED = {"pk": "symbol", "ps": "since", "pn": "count"}
_EMPTY = {"cur": "nothing", "start": "nothing", "n": "zero", "done": "no"}
#: The first situation that holds gives the fields' next values, by name, and whether what is then held was just read.
TABLE: tuple[tuple[str, dict[str, str], bool], ...] = (
    ("blank with nothing held", _UNDISPUTED, False),
    ("blank for long", _EMPTY | _UNDISPUTED, False),
    ("blank", _DISPUTED, False),
    ("the held symbol", {"n": "more"} | _UNDISPUTED, True),
    ("a symbol with nothing held", {"cur": "symbol", "start": "now", "n": "one", "done": "no"} | _UNDISPUTED, True),
    ("another symbol for long", {"cur": "symbol", "start": "since", "n": "count", "done": "no"} | _UNDISPUTED, True),
    ("another symbol", _DISPUTED, False),
)


class Holds:
    """TABLE for one stream, reading by reading."""

    def __init__(self, config: DebounceConfig, state: dict | None = None) -> None:
        self.config = config
        self.state = state or {"last": None, "seen": None} | dict.fromkeys(FIELDS) | {"n": 0, "done": False, "pn": 0}

    def _situation(self, symbol: str, t: float, since: float, count: int) -> str:
        c, s = self.config, self.state
        if symbol:
            if symbol == s["cur"]:
                return "the held symbol"
            if s["cur"] is None:
                return "a symbol with nothing held"
            return "another symbol for long" if t - since >= c.switch_ms else "another symbol"
        if s["cur"] is None:
            return "blank with nothing held"
        # An absence counts from the last reading of any symbol.
        return "blank for long" if t - s["seen"] >= c.blank_ms and count >= c.min_blank_frames else "blank"

    def feed(self, symbol: str, t: float) -> str | None:
        """The symbol that this reading commits, if any; '' is no reading."""
        c, s = self.config, self.state
        if symbol:
            s["seen"] = t
        since, count = (s["ps"], s["pn"] + 1) if s["pk"] == symbol else (t, 1)
        value = {"nothing": None, "zero": 0, "no": False, "one": 1, "more": s["n"] + 1, "symbol": symbol, "now": t, "since": since, "count": count}
        situation = self._situation(symbol, t, since, count)
        put, saw = next((put, saw) for name, put, saw in TABLE if name == situation)
        s.update({f: value[v] for f, v in put.items()})
        if situation == "blank for long":
            s["last"] = None
        if not saw or s["done"] or t - s["start"] < c.min_hold_ms or s["n"] < c.min_hold_frames:
            return None
        s["done"] = True
        # A symbol commits once until an absence, however often it is taken over in between.
        news, s["last"] = s["cur"] != s["last"], s["cur"]
        return s["cur"] if news else None

    def release(self) -> None:
        """Forget what is held and what was committed: after a motion, or a reset."""
        self.state.update(dict.fromkeys(FIELDS) | {"n": 0, "done": False, "pn": 0, "last": None})
