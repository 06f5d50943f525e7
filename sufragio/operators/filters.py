"""The filter vector shared by all queries. A filter whose role the source lacks is ignored."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sufragio.functions import labels, text
from sufragio.operators.fact import Fact


def folded(value: str) -> str:
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
    return re.sub(r"\s+", " ", plain).strip().upper()


def state_filter(value: str | None) -> str | None:
    """Capitals; the whole country is no filter."""
    key = (value or "").strip().upper()
    return None if key in ("", "BR", "BRASIL") else key


@dataclass(frozen=True)
class Scope:
    year: int | None = None
    round: int | None = None
    state: str | None = None
    office: str | None = None
    party: str | None = None
    place: str | None = None
    elected_only: bool = False

    def condition(self, fact: Fact) -> Column:
        out = F.lit(True)
        if self.year is not None and fact.has("year"):
            out = out & (F.col("year") == self.year)
        if self.round is not None and fact.has("round"):
            out = out & (F.col("round") == self.round)
        if state_filter(self.state) and fact.has("state"):
            out = out & (F.col("state") == state_filter(self.state))
        if self.office and fact.has("office"):
            out = out & (F.col("office_key") == self.office.strip().upper())
        if self.party and fact.has("party"):
            out = out & (text.fold_upper(F.col("party")) == folded(self.party))
        if self.place and fact.has("place"):
            key = folded(self.place)
            out = out & (F.col("place_key") == labels.PLACE_ALIASES.get(key, key))
        if self.elected_only and fact.has("status"):
            out = out & F.col("elected")
        return out

    def apply(self, fact: Fact) -> Fact:
        return fact.where(self.condition(fact))

    @property
    def presidential(self) -> bool:
        """The whole country's vote for president."""
        return (self.office or "").strip().upper() == "PRESIDENTE" and not state_filter(self.state) and not self.place

    @property
    def broad(self) -> bool:
        return not (self.state or self.office or self.party or self.place)


def search_key(query: str, scope: Scope) -> str | None:
    """The folded query; None where it is too short: under two characters, or in the whole country
    under eight letters."""
    key = folded(query)
    short = len(key) < 2 or (scope.broad and len(re.sub(r"[^A-Z]", "", key)) < 8)
    return None if short else key


def is_candidate(candidate: str, cpf: str | None = None) -> Column:
    """Rows of a candidate: by number digits if given, else by source id, ballot number, number
    digits (only if the id has digits) or folded name."""
    own = re.sub(r"\D", "", cpf or "")
    if own:
        return F.col("cpf") == own
    key = candidate.strip()
    # a key of digits alone is compared with the name as it stands: folding every name costs more
    named = F.coalesce(F.col("name"), F.lit("")) == key if key.isdigit() else F.col("name_key") == folded(key)
    out = (F.coalesce("source_id", F.lit("")) == key) | (F.coalesce("number", F.lit("")) == key) | named
    only = re.sub(r"\D", "", key)
    return out | (F.col("cpf") == only) if only else out
