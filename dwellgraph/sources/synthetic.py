"""A synthetic source of listings as a Spark data source: pages as partitions, pushed filters, revisions as stream offsets."""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from dwellgraph.operators.lineage import importable

NAME = "synthetic_listings"
#: Bounds of a request, cities with their centres, base rents and districts, and streets.
LIMIT, REVISIONS = 1000, 20
CITIES = {"Львів": (49.839683, 24.029717, 14_500), "Рівне": (50.6199, 26.251617, 10_500), "Київ": (50.4501, 30.5234, 18_500)}
DISTRICTS = {"Львів": ("Франківський", "Шевченківський", "Галицький", "Сихівський"), "Рівне": ("Центр", "Північний", "Ювілейний", "Щасливе"), "Київ": ("Шевченківський", "Подільський", "Солом'янський", "Дарницький")}
STREETS = ("Зелена", "Городоцька", "Соборна", "Київська", "Наукова", "Бандери")
#: Of each CYCLE rows the first COPIES tell of one flat, at prices a little apart.
CYCLE, COPIES = 12, (-350, 0, 450)
LOWEST = 6000
TOLD = {0: "Вигаданий приклад: просять передоплату до перегляду, тож це лише перевірка ознак ризику.", 1: "Вигаданий короткий опис.", 3: "Вигадане докладне оголошення: умови договору, площа, поверх, опалення й комунальні платежі описані, оплата лише після перегляду та перевірки документів. Такої квартири немає."}
PLAIN, COPIED = "Вигадане оголошення, такої квартири немає.", "Вигадана копія оголошення для перевірки дублікатів, публікація {}."
NEWEST = datetime.datetime(2026, 7, 16, 12, 0)

SCHEMA = """external_id string, url string, title string, description string, city string, district string, street string, latitude double, longitude double, location_accuracy string, price bigint, rooms int, total_area double,
  floor int, floors_total int, building_type string, renovation_level string, heating_type string, pets_allowed boolean, children_allowed boolean, commission_percent int, is_owner boolean, images array<string>, published_at timestamp, attributes string, revision int"""
_PREFIX = "synthetic-"


def _draw(seed: int, of: str, field: str, n: int) -> int:
    """A number below n that depends on the seed, the flat or row, and the field only."""
    return int.from_bytes(hashlib.blake2b(f"{seed}|{of}|{field}".encode(), digest_size=8).digest(), "big") % n


def _pick(seed: int, of: str, field: str, values: tuple):
    return values[_draw(seed, of, field, len(values))]


def city_of(number: int) -> str:
    """The city of a row: copies of one flat are in one, and turns go round by the lap, others by the row."""
    lap, place = divmod(number, CYCLE)
    return tuple(CITIES)[(lap if place < len(COPIES) else number) % len(CITIES)]


def price_of(number: int, price: float, revision: int) -> int:
    """The price of a row in a revision: some cost far too little, some change in the second, a few again in the third."""
    if number % 30 == 2:
        price = round(price * 0.68)
    if revision >= 2 and number % 20 < 2:
        price = round(price * (0.90, 1.08)[number % 20])
    if revision >= 3 and number % 45 == 0:
        price = round(price * 0.94)
    return max(LOWEST, int(price))


def row(number: int, seed: int, revision: int) -> dict:
    """The raw listing of a number, from it, the seed and the revision alone: so any part can be made anywhere, again and again."""
    lap, place = divmod(number, CYCLE)
    copy = place < len(COPIES)
    name = f"{_PREFIX}{number + 1:04d}"
    flat = f"flat-{lap:03d}" if copy else name
    draw = lambda field, n: _draw(seed, flat, field, n)
    pick = lambda field, *values: _pick(seed, flat, field, values)
    city = city_of(number)
    lat, lon, base = CITIES[city]
    district, rooms = pick("district", *DISTRICTS[city]), 1 + draw("rooms", 4)
    low, high = 280 + 70 * rooms, 420 + 180 * rooms
    rent = max(LOWEST, base + rooms * (1800 + draw("per_room", 2101)) + draw("offset", 6001) - 2500) + (COPIES[place] if copy else 0)
    floor = 1 + draw("floor", 14)
    floors = max(floor, 5 + draw("floors", 14))
    titles = (f"{rooms}-кімнатна квартира · {district}", f"Здам {rooms}-кімнатну квартиру, {district}", f"Квартира, кімнат: {rooms}, район {district}")
    attributes = {"balcony": pick("balcony", True, False), "elevator": floors > 5, "furniture": pick("furniture", True, False), "backup_power": pick("backup_power", True, False, None), "demo": True, "demo_revision": revision}
    attributes |= {"demo_image_hashes": ["shared-image"]} if number in (5, 6) else {}
    attributes |= {"relisted_count": 4} if number % 25 == 4 else {}
    attributes |= {"hidden_commission": True} if number % 30 == 7 else {}
    attributes |= {"demo_duplicate_group": flat, "building_number": 10 + lap, "contacts": {"agent": [{"phone": f"067{1_000_000 + lap:07d}"}]}} if copy else {}
    return {
        "external_id": name, "url": f"https://example.invalid/listings/{name}", "title": titles[place if copy else 0], "description": TOLD.get(number % 30, COPIED.format(place + 1) if copy else PLAIN),
        "city": city, "district": district, "street": pick("street", *STREETS), "latitude": round(lat + (draw("lat", 90_001) - 45_000) / 1e6, 6), "longitude": round(lon + (draw("lon", 130_001) - 65_000) / 1e6, 6),
        "location_accuracy": "building", "price": price_of(number, rent, revision), "rooms": rooms, "total_area": (low + draw("area", high - low + 1)) / 10, "floor": floor, "floors_total": floors,
        "building_type": pick("building", "new_building", "brick", "panel", "historical"), "renovation_level": pick("renovation", "modern", "good", "cosmetic", "needs_repair"), "heating_type": pick("heating", "individual", "central", "electric"),
        "pets_allowed": pick("pets", True, False, None), "children_allowed": pick("children", True, True, False, None), "commission_percent": pick("commission", 0, 50, 100, None), "is_owner": pick("owner", True, False, None),
        "images": [], "published_at": NEWEST - datetime.timedelta(minutes=5 + _draw(seed, name, "published", 14_396)), "attributes": json.dumps(attributes, ensure_ascii=False), "revision": revision,
    }


@dataclass(frozen=True)
class Options:
    """limit rows (1 to 1000) on each of pages, of a seed, in a revision (1 to 20)."""

    limit: int
    pages: int
    seed: int
    revision: int

    @classmethod
    def of(cls, options: dict) -> Options:
        got = cls(*(int(options.get(n, d)) for n, d in (("limit", 150), ("pages", 1), ("seed", 20260716), ("revision", 1))))
        if not 1 <= got.limit <= LIMIT:
            raise ValueError(f"limit is from 1 to {LIMIT}")
        if not 1 <= got.revision <= REVISIONS:
            raise ValueError(f"revision is from 1 to {REVISIONS}")
        if got.pages < 1:
            raise ValueError("pages is 1 or more")
        return got


@dataclass
class Page(InputPartition):
    """The rows of some numbers in a revision."""

    first: int
    end: int
    revision: int


class Reader(DataSourceReader):
    """Reads pages. A filter for external ids leaves their numbers only, one for a city leaves rows of others unmade."""

    def __init__(self, options: Options, columns: list[str]):
        self.options, self.columns = options, columns
        self.numbers: set[int] | None = None
        self.cities: set[str] | None = None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("external_id",), ("city",)):
                yield f
            elif f.attribute == ("city",):
                self.cities = values if self.cities is None else self.cities & values
            else:
                made = {n for v in values if (n := number_of(v)) is not None}
                self.numbers = made if self.numbers is None else self.numbers & made

    def partitions(self) -> list[Page]:
        o = self.options
        pages = [Page(k * o.limit, (k + 1) * o.limit, o.revision) for k in range(o.pages)]
        return [p for p in pages if self.numbers is None or any(p.first <= n < p.end for n in self.numbers)] or [Page(0, 0, o.revision)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for n in range(partition.first, partition.end):
            if (self.numbers is None or n in self.numbers) and (self.cities is None or city_of(n) in self.cities):
                made = row(n, self.options.seed, partition.revision)
                yield tuple(made[c] for c in self.columns)


def number_of(external_id: str | None) -> int | None:
    """The number that an external id names, if it is the id of one."""
    digits = (external_id or "").removeprefix(_PREFIX)
    number = int(digits) - 1 if digits.isascii() and digits.isdigit() else -1
    return number if number >= 0 and external_id == f"{_PREFIX}{number + 1:04d}" else None


class StreamReader(DataSourceStreamReader):
    """Every revision up to the asked one, each as one offset: a restart goes on behind the last that was committed."""

    def __init__(self, options: Options, columns: list[str]):
        self.reader = Reader(options, columns)

    def initialOffset(self) -> dict:
        return {"revision": 0}

    def latestOffset(self) -> dict:
        return {"revision": self.reader.options.revision}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        o = self.reader.options
        return [Page(k * o.limit, (k + 1) * o.limit, r) for r in range(start["revision"] + 1, end["revision"] + 1) for k in range(o.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class SyntheticListings(DataSource):
    """`spark.read.format("synthetic_listings")` with options limit, pages, seed, revision; also as a stream."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(Options.of(self.options), schema.names)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Options.of(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with pushed filters."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SyntheticListings)
