"""The command fold: an ordered log of commands for each event becomes accepted ledger rows and rejects.

Guards depend on all state before, so commands of one event are folded in order; different events fold in parallel, and a task streams through the
sorted commands of its events. State is bounded by the event's teams and players, not by its history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ROLE_ALIASES

OUT = "event_id long, seq long, command string, accepted boolean, reason string, tx_sequence long, player_id string, team_id string, price long, remaining long"
BATCH = 10_000


@dataclass(frozen=True)
class Settings:
    """Rules of an event. ``settings.update`` replaces any of them before the start; a role rule is (least, most), open if there is no most."""

    base_price: int = 100
    purse: int = 1_000_000
    step: int = 50
    tiers: tuple[tuple[int | None, int], ...] = ()
    min_squad: int = 0
    max_squad: int | None = None
    reintroduce: bool = True
    allow_override: bool = True
    show_others: bool = True
    reveal_next: bool = False
    require_pin: bool = False
    name: str = "Event"
    currency_symbol: str = "₹"
    roles: dict[str, str] = field(default_factory=dict)  # player -> role, for players that were added without one
    role_max: dict[str, int] = field(default_factory=dict)  # role -> most of it in a squad; absent: open
    role_min: dict[str, int] = field(default_factory=dict)

    def increment(self, price: int) -> int:
        return next((i for up, i in self.tiers if up is None or price <= up), self.step)


def problem(s: Settings) -> str | None:
    """What is wrong with new settings."""
    whole = lambda x, low: isinstance(x, int) and not isinstance(x, bool) and x >= low
    switches = (s.reintroduce, s.allow_override, s.show_others, s.reveal_next, s.require_pin)
    ups = [u for u, _ in s.tiers]
    checks = (
        (bool(str(s.name).strip()), "name is required"),
        (0 < len(str(s.currency_symbol)) <= 6, "bad currency symbol"),
        (whole(s.purse, 1) and whole(s.step, 1) and whole(s.base_price, 1), "bad amount"),
        (whole(s.min_squad, 0) and (s.max_squad is None or whole(s.max_squad, 1)), "bad squad size"),
        (all(isinstance(x, bool) for x in switches), "a switch is no boolean"),
        (all((u is None or whole(u, 1)) and whole(i, 1) for u, i in s.tiers), "bad tier"),
        (None not in ups[:-1], "an open tier must be the last"),
        (all(b is None or b > a for a, b in zip(ups, ups[1:], strict=False) if a is not None), "tiers must rise"),
        (all(whole(x, 0) for x in (*s.role_max.values(), *s.role_min.values())), "bad role rule"),
        (all(s.role_max.get(r, n) >= n for r, n in s.role_min.items()), "a role's most is below its least"),
        (s.max_squad is None or s.min_squad <= s.max_squad, "least squad size above the most"),
    )
    return next((reason for ok, reason in checks if not ok), None)


@dataclass
class Team:
    id: str
    name: str
    purse: int
    active: bool = True
    pin: bool = False
    owner: str = ""


@dataclass
class Player:
    id: str
    name: str
    role: str | None
    base: int
    status: str = "available"


class Refused(Exception):
    pass


@dataclass
class Auction:
    """State of one event and its commands. A refused command leaves the state as it was."""

    settings: Settings = field(default_factory=Settings)
    status: str = "not-started"
    teams: dict[str, Team] = field(default_factory=dict)
    players: dict[str, Player] = field(default_factory=dict)
    spent: dict[str, int] = field(default_factory=dict)
    current: str | None = None
    bid: int | None = None
    bid_team: str | None = None
    sequence: int = 0
    last: tuple | None = None  # the last transaction: kind, player, team, price, bid and team before it
    owner: dict[str, tuple[str, int]] = field(default_factory=dict)  # sold player -> team, price
    latest: dict[str, str] = field(default_factory=dict)  # player -> kind of its latest transaction

    def need(self, ok: bool, reason: str) -> None:
        if not ok:
            raise Refused(reason)

    def remaining(self, team: str | None) -> int | None:
        return self.teams[team].purse - self.spent.get(team, 0) if team in self.teams else None

    def squad(self, team: str) -> list[str]:
        return [p for p, (t, _) in self.owner.items() if t == team]

    def role(self, player: str | None) -> str | None:
        return (self.players[player].role if player in self.players else None) or self.settings.roles.get(player)

    def apply(self, command: str, player: str | None, team: str | None, amount: int | None, override: bool, details: dict | None = None) -> tuple:
        """(sequence or None, player, team, price)"""
        do = getattr(self, "do_" + command.replace(".", "_").replace("-", "_"), None)
        self.need(do is not None, "unknown command")
        return do(player, team, amount, override, details or {}) or (None, player, team, amount)

    def setup(self) -> None:
        self.need(self.status == "not-started", "already started")

    def new_team(self, team: str | None, amount: int | None, d: dict, old: Team | None = None) -> Team:
        was = old or Team(team or "", team or "", self.settings.purse)
        made = Team(str(d.get("id") or team or was.id), str(d.get("name") or was.name).strip(), amount if amount is not None else d.get("initialPurse", was.purse), d.get("active", was.active) is True, bool(d.get("pin")) or (was.pin and not d.get("clearPin")), str(d.get("owner", was.owner)))
        self.need(bool(made.id) and bool(made.name), "id and name are required")
        self.need(isinstance(made.purse, int) and made.purse > 0, "bad amount")
        self.need(not d.get("pin") or (str(d["pin"]).isascii() and str(d["pin"]).isdigit() and 4 <= len(str(d["pin"])) <= 12), "bad pin")
        self.need(not self.pins_needed(self.settings) or not made.active or made.pin, "needs a pin")
        return made

    def new_player(self, player: str | None, amount: int | None, d: dict, old: Player | None = None) -> Player:
        was = old or Player(player or "", player or "", None, self.settings.base_price)
        role = ROLE_ALIASES.get(str(d["role"]).strip().lower()) if "role" in d else was.role
        self.need("role" not in d or role is not None, "unknown role")
        made = Player(str(d.get("id") or player or was.id), str(d.get("name") or was.name).strip(), role, amount if amount is not None else d.get("basePrice", was.base), was.status)
        self.need(bool(made.id) and bool(made.name), "id and name are required")
        self.need(isinstance(made.base, int) and made.base > 0, "bad amount")
        return made

    def pins_needed(self, s: Settings) -> bool:
        return s.require_pin or not s.show_others

    def do_team_add(self, player, team, amount, override, d):
        self.setup()
        made = self.new_team(team, amount, d)
        self.need(made.id not in self.teams, "team exists")
        self.need(all(t.name.lower() != made.name.lower() for t in self.teams.values()), "team name exists")
        self.teams[made.id] = made

    def do_player_add(self, player, team, amount, override, d):
        self.setup()
        made = self.new_player(player, amount, d)
        self.need(made.id not in self.players, "player exists")
        self.players[made.id] = made

    def do_team_update(self, player, team, amount, override, d):
        self.setup()
        self.need(team in self.teams, "no such team")
        self.need(amount is not None or bool(d), "bad amount")
        made = self.new_team(None, amount, d, self.teams[team])
        self.need(made.id == team or made.id not in self.teams, "team exists")
        self.need(all(t.name.lower() != made.name.lower() for i, t in self.teams.items() if i != team), "team name exists")
        self.teams = {(made.id if i == team else i): (made if i == team else t) for i, t in self.teams.items()}

    def do_team_remove(self, player, team, amount, override, d):
        self.setup()
        self.need(team in self.teams, "no such team")
        self.need(not self.squad(team), "has sold players")
        del self.teams[team]

    def do_player_update(self, player, team, amount, override, d):
        self.setup()
        self.need(player in self.players, "no such player")
        self.need(amount is not None or bool(d), "bad amount")
        made = self.new_player(None, amount, d, self.players[player])
        self.need(made.id == player or made.id not in self.players, "player exists")
        self.players = {(made.id if i == player else i): (made if i == player else p) for i, p in self.players.items()}

    def do_player_remove(self, player, team, amount, override, d):
        self.setup()
        self.need(player in self.players, "no such player")
        self.need(player not in self.latest, "has a history")
        del self.players[player]

    def do_player_import(self, player, team, amount, override, d):
        """All rows or none."""
        self.setup()
        self.need(bool(d.get("rows")), "no rows")
        rows = dict(self.players)
        for r in d["rows"]:
            made = self.new_player(r.get("id"), None, r)
            self.need(made.id not in rows, "player exists")
            rows[made.id] = made
        self.players = rows

    def do_team_import(self, player, team, amount, override, d):
        self.setup()
        self.need(bool(d.get("rows")), "no rows")
        rows, names = dict(self.teams), {t.name.lower() for t in self.teams.values()}
        for r in d["rows"]:
            made = self.new_team(r.get("id"), None, r)
            self.need(made.id not in rows, "team exists")
            self.need(made.name.lower() not in names, "team name exists")
            rows[made.id] = made
            names.add(made.name.lower())
        self.teams = rows

    def do_settings_update(self, player, team, amount, override, d):
        self.setup()
        known = {f.name for f in fields(Settings)}
        new = replace(self.settings, **{k: tuple(map(tuple, v)) if k == "tiers" else v for k, v in d.items() if k in known})
        wrong = problem(new)
        self.need(wrong is None, wrong or "")
        self.need(not self.pins_needed(new) or all(t.pin for t in self.teams.values() if t.active), "needs a pin")
        self.settings = new

    def do_start(self, player, team, amount, override, d):
        self.setup()
        self.need(any(t.active for t in self.teams.values()) and bool(self.players), "needs an active team and a player")
        self.need(not self.pins_needed(self.settings) or all(t.pin for t in self.teams.values() if t.active), "needs a pin")
        self.status = "live"

    def do_pause(self, player, team, amount, override, d):
        self.need(self.status == "live", "not live")
        self.status = "paused"

    def do_resume(self, player, team, amount, override, d):
        self.need(self.status == "paused", "not paused")
        self.status = "live"

    def do_end(self, player, team, amount, override, d):
        self.need(self.status in ("live", "paused"), "not running")
        self.need(self.current is None, "a player is current")
        self.status = "completed"

    def do_player_select(self, player, team, amount, override, d):
        self.need(self.status == "live", "not live")
        self.need(self.current is None, "a player is current")
        state = self.players[player].status if player in self.players else None
        self.need(state == "available" or (state == "unsold" and self.settings.reintroduce), "not eligible")
        self.players[player].status, self.current, self.bid, self.bid_team = "current", player, None, None

    def can_add(self, team: str | None, price: int) -> None:
        self.need(team in self.teams and self.teams[team].active, "no such team")
        self.need(price <= self.remaining(team), "beyond the purse")
        squad = self.squad(team)
        self.need(self.settings.max_squad is None or len(squad) < self.settings.max_squad, "squad is full")
        role = self.role(self.current)
        most = self.settings.role_max.get(role)
        self.need(most is None or sum(self.role(p) == role for p in squad) < most, "role is full")

    def do_bid(self, player, team, amount, override, d):
        self.need(self.status == "live", "not live")
        self.need(self.current is not None, "no current player")
        self.need(amount is not None and amount >= 1, "bad amount")
        self.need(not override or self.settings.allow_override, "overrides are off")
        base = self.players[self.current].base
        low = base if self.bid is None else self.bid + self.settings.increment(self.bid)
        step = self.settings.increment(base if self.bid is None else self.bid)
        self.need(override or (amount >= low and (amount - low) % step == 0), "breaks the increment rule")
        self.need(self.bid is None or amount > self.bid, "not above the highest bid")
        self.can_add(team, amount)
        self.bid, self.bid_team = amount, team
        return None, self.current, team, amount

    def do_sell(self, player, team, amount, override, d):
        self.need(self.status == "live", "not live")
        self.need(self.current is not None, "no current player")
        self.need(self.bid is not None, "no bid")
        price, buyer = self.bid if amount is None else amount, team or self.bid_team
        self.need(price >= self.players[self.current].base, "below the base price")
        self.need(not override or self.settings.allow_override, "overrides are off")
        self.need(override or (price == self.bid and buyer == self.bid_team), "not the highest bid")
        self.can_add(buyer, price)
        who = self.current
        self.record("sale", who, buyer, price)
        self.players[who].status, self.current, self.bid, self.bid_team = "sold", None, None, None
        self.owner[who] = buyer, price
        self.spent[buyer] = self.spent.get(buyer, 0) + price
        return self.sequence, who, buyer, price

    def record(self, kind: str, player: str, team: str | None = None, price: int | None = None) -> None:
        self.sequence += 1
        self.last = kind, player, team, price, self.bid, self.bid_team
        self.latest[player] = kind

    def do_unsold(self, player, team, amount, override, d):
        self.need(self.status == "live", "not live")
        self.need(self.current is not None, "no current player")
        self.need(self.bid is None or (override and self.settings.allow_override), "has a bid")
        who = self.current
        self.record("unsold", who)
        self.players[who].status, self.current, self.bid, self.bid_team = "unsold", None, None, None
        return self.sequence, who, None, None

    def do_undo(self, player, team, amount, override, d):
        """Only the last transaction, and only a sale. A current player without a bid goes back to what its own latest transaction left."""
        self.need(self.last is not None and self.last[0] == "sale", "nothing to undo")
        _, who, buyer, price, bid, bid_team = self.last
        if self.current is not None:
            self.need(self.bid is None, "the current player has a bid")
            self.players[self.current].status = "unsold" if self.latest.get(self.current) == "unsold" else "available"
        self.players[who].status = "current"
        self.current, self.bid, self.bid_team = who, price if bid is None else bid, bid_team or buyer
        del self.owner[who]
        self.spent[buyer] -= price
        self.record("undo", who, buyer, price)
        return self.sequence, who, buyer, price

    def do_reset(self, player, team, amount, override, d):
        for p in self.players.values():
            p.status = "available"
        self.owner.clear()
        self.spent.clear()
        self.latest.clear()
        self.status, self.current, self.bid, self.bid_team, self.sequence, self.last = "not-started", None, None, None, 0, None


def run_commands(rows: Iterator[tuple], settings: Settings) -> list[tuple]:
    """(seq, command, accepted, reason, tx_sequence, player, team, price, remaining) for each command (seq, command, player, team, amount, override[, details]) in order."""
    state = Auction(settings)
    return [step(state, r) for r in rows]


def step(state: Auction, row: tuple) -> tuple:
    seq, command, player, team, amount, override, *details = row
    try:
        tx, who, buyer, price = state.apply(command, player, team, amount, bool(override), details[0] if details else None)
        return seq, command, True, None, tx, who, buyer, price, state.remaining(buyer)
    except Refused as e:
        return seq, command, False, str(e), None, player, team, amount, state.remaining(team)


def parsed(details: str | None) -> dict | None:
    """A JSON object; anything else counts as none."""
    try:
        d = json.loads(details) if details else None
    except ValueError:
        return None
    return d if isinstance(d, dict) else None


def fold(log: DataFrame, settings: Settings | None = None) -> DataFrame:
    """log: event_id long, seq long, command, player_id, team_id string, amount long, override boolean; a string column ``details`` may hold a JSON object with
    names, roles, switches, settings or rows to import. Commands are folded in the order of seq."""
    settings = settings or Settings()
    columns = ["event_id", "seq", "command", "player_id", "team_id", "amount", "override", *[c for c in log.columns if c == "details"]]
    wire = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in OUT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        event, state = object(), None
        for b in batches:
            out = []
            for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != event or state is None:
                    event, state = key, Auction(settings)
                if len(row) > 6:
                    row[6] = parsed(row[6])
                out.append((key, *step(state, tuple(row))))
            for i in range(0, len(out), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + BATCH], strict=True), wire, strict=True)], schema=wire)

    return log.select(*columns).repartition("event_id").sortWithinPartitions(F.col("event_id"), F.col("seq")).mapInArrow(run, OUT)
