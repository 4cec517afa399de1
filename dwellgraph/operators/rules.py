"""Texts made by rules: search texts read, listings summed up, questions and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgraph.functions.text import money

#: Spellings of cities in search texts.
CITY_NAMES = {"львів": "Львів", "львові": "Львів", "рівне": "Рівне", "рівному": "Рівне", "київ": "Київ", "києві": "Київ"}
#: What a search text says of rooms and prices, and words that switch on a filter.
ROOMS = r"([0-9]+)\s*[- ]?(?:кімнат|кімнати|кімнатну|кімнатна)"
THOUSANDS = r"(?:до|max(?:imum)?\s*)\s?([0-9]{2,3})(?:\s?тисяч|\s?тис)"
AMOUNT = r"(?:до|max(?:imum)?\s*)\s?([0-9]{4,6})"
MINUTES = r"до\s+([0-9]{1,3})\s*(?:хв|хвилин)"
FLAGS = {"exclude_first_floor": ("не перший",), "exclude_last_floor": ("не останній",), "new_building": ("новобуд",), "no_commission": ("без коміс", "комісію платити не хочу"), "cat": ("кіт", "кот"), "dog": ("собак", "пес")}
PLACES = {"політех": ("Львівська політехніка", 5), "університет": ("університет", 4), "робот": ("робота", 4)}
#: Confidences of what was read.
CONFIDENCE = {"city": 0.98, "price_thousands": 0.96, "price_amount": 0.92, "rooms_figure": 0.97, "rooms_word": 0.98, "exclude_first_floor": 0.99, "exclude_last_floor": 0.99, "new_building": 0.95, "no_commission": 0.98, "cat": 0.97, "dog": 0.97, "minutes": 0.86, "minutes_guessed": 0.55}


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(parts))


def parse_search(texts: DataFrame, *, text: str = "text") -> DataFrame:
    """The texts with what they ask for: city, rooms, price_max, a flag for each of FLAGS, place, minutes, missing, and confidences.

    Words are looked for anywhere, within other words too, as the reference does; of several cities and
    places the first of the list counts. Null texts ask for nothing.
    """
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    number = lambda pattern: F.when(low.rlike(pattern), F.regexp_extract(low, pattern, 1).try_cast("bigint"))
    city = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in CITY_NAMES.items()])
    word = F.when(F.contains(low, F.lit("однокімнат")), F.lit(1)).when(F.contains(low, F.lit("двокімнат")), F.lit(2)).cast("bigint")
    place = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.struct(F.lit(n).alias("name"), F.lit(i).alias("importance"))) for k, (n, i) in PLACES.items()])
    minutes = F.when(place.isNotNull(), F.coalesce(F.greatest(F.lit(1), F.least(F.lit(240), number(MINUTES))), F.lit(30)))
    sure = lambda on, name: F.when(on, F.lit(CONFIDENCE[name]))
    made = texts.withColumns({
        "city": city, "rooms": F.coalesce(number(ROOMS), word), "price_max": F.coalesce(number(THOUSANDS) * 1000, number(AMOUNT)), **{n: _any(low, parts) for n, parts in FLAGS.items()},
        "place": place["name"], "importance": place["importance"].cast("bigint"), "minutes": minutes.cast("bigint"),
        "city_confidence": sure(city.isNotNull(), "city"), "rooms_confidence": F.coalesce(sure(low.rlike(ROOMS), "rooms_figure"), sure(word.isNotNull(), "rooms_word")),
        "price_confidence": F.coalesce(sure(low.rlike(THOUSANDS), "price_thousands"), sure(low.rlike(AMOUNT), "price_amount")), "minutes_confidence": F.when(place.isNotNull(), F.coalesce(sure(low.rlike(MINUTES), "minutes"), F.lit(CONFIDENCE["minutes_guessed"]))),
    })
    lacking = [F.when(F.col(n).isNull(), F.lit(n)) for n in ("city", "price_max", "rooms")]
    return made.withColumn("missing", F.concat_ws(",", *lacking))


def _told(*rules: tuple[Column, Column | str]) -> Column:
    """The texts of the rules that hold, in their order, eight at most."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(say) if isinstance(say, str) else say) for on, say in rules]))
    return F.slice(held, 1, 8)


def _given(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def summaries(listings: DataFrame) -> DataFrame:
    """(id, summary, advantages, caveats, unknowns) of each listing; the three are arrays of eight texts at most.

    Three-valued columns (pets_allowed, children_allowed, is_owner, backup_power) are unknown where null.
    """
    c = F.col
    shown = lambda n, otherwise: F.when(_given(n), c(n).cast("string")).otherwise(otherwise)
    floor = F.when(_given("floor") & _given("floors_total") & (c("floor") != 0), F.concat_ws("/", "floor", "floors_total")).otherwise("потрібно уточнити")
    area = F.when(_given("total_area") & (c("total_area") != 0), F.concat(F.lit(", "), c("total_area").cast("string"), F.lit(" м²"))).otherwise("")
    text = F.concat(
        shown("rooms", "?"), F.lit("-кімнатний варіант у місті "), shown("city", "місто не вказано"), F.lit(", "), shown("district", "район не вказано"), F.lit(", за "), money(c("price_uah")), area,
        F.lit(". Поверх: "), floor, F.lit(". Перевірте невідомі умови перед домовленістю про перегляд."),
    )
    known, fee = _given("commission_percent"), c("commission_percent").cast("double")
    return listings.select(
        "id",
        text.alias("summary"),
        _told(
            (c("pets_allowed"), "Можна з домашніми тваринами."),
            (known & (fee == 0), "Комісія не заявлена."),
            (c("is_owner"), "Оголошення позначене як від власника."),
            (_given("building_type"), F.concat(F.lit("Тип будинку: "), c("building_type"), F.lit("."))),
            (c("backup_power"), "Заявлене резервне живлення."),
        ).alias("advantages"),
        _told(
            (~c("pets_allowed"), "Тварини вказані як небажані або заборонені."),
            (~c("children_allowed"), "Проживання з дітьми вказане як небажане або заборонене."),
            (known & (fee != 0), F.concat(F.lit("Комісія заявлена: "), c("commission_percent").cast("string"), F.lit("%."))),
        ).alias("caveats"),
        _told(
            (c("pets_allowed").isNull(), "Умови проживання з тваринами не вказані."),
            (c("children_allowed").isNull(), "Умови проживання з дітьми не вказані."),
            (~known, "Комісія не вказана."),
            (c("is_owner").isNull(), "Не підтверджено, власник це чи представник."),
            (~_given("building_type"), "Тип будинку не вказано."),
            (c("backup_power").isNull(), "Немає інформації про резервне живлення."),
        ).alias("unknowns"),
    )


#: Questions that are always asked, and names of pets.
ALWAYS = ("Чи актуальна квартира?", "Ви власник чи представник?", "Яка комісія та розмір застави?", "Коли можна подивитися квартиру?", "Чи укладається офіційний договір?", "Які приблизні комунальні платежі взимку?")
PETS = {"cat": "кіт", "dog": "собака"}


def owner_questions(listings: DataFrame, *, pets: tuple[str, ...] = (), children: bool = False, power: bool = False, parking: bool = False) -> DataFrame:
    """(id, questions, message): what to ask an owner, given a profile's wishes; twelve questions at most, each once.

    The message holds the first five. A wish that the listing grants is not asked for.
    """
    c = F.col
    lacks = lambda n: ~F.coalesce(c(n), F.lit(False))
    about_pets = f"Чи можна проживати з домашніми тваринами ({', '.join(PETS.get(p, p) for p in pets)})?" if pets else "Чи можна проживати з котом або собакою?"
    rules = [
        (lacks("pets_allowed"), about_pets),
        (F.lit(children) & lacks("children_allowed"), "Чи можна проживати з дитиною або дітьми?"),
        (~_given("heating_type"), "Який тип опалення?"),
        (lacks("backup_power") | F.lit(power), "Чи є резервне живлення або інвертор?"),
        (F.lit(parking) & lacks("parking") if "parking" in listings.columns else F.lit(parking), "Чи є закріплене або безпечне місце для паркування?"),
        (c("floor") > 4, "Чи працює ліфт під час відключень?"),
    ]
    asked = F.array_distinct(F.concat(F.array(*[F.lit(q) for q in ALWAYS]), _told(*rules)))
    told = listings.select("id", F.slice(asked, 1, 12).alias("questions"))
    return told.withColumn("message", F.concat(F.lit("Добрий день! "), F.array_join(F.slice("questions", 1, 5), " ")))


def comparisons(rows: DataFrame, group: str, *, lead: int = 5) -> DataFrame:
    """(group, recommended, decisive, unknowns, recommendation) of the listings of each group.

    The best has the greatest score, then fewest unknowns, then the least price, then the greatest area, then
    the smallest id. It is decisive if it stands alone or leads by so many points; without a score (null)
    nothing is recommended. unknowns is the sorted union over the group. rows has id, title, score, and the
    listing's columns; risk_score and travel_minutes where known.
    """
    c = F.col
    maybe = lambda n: c(n) if n in rows.columns else F.lit(None)
    empty = {
        "commission": ~_given("commission_percent"), "pets": c("pets_allowed").isNull(), "children": c("children_allowed").isNull(), "heating": ~_given("heating_type"), "area": ~_given("total_area") | (c("total_area") == 0),
        "renovation": ~_given("renovation_level"), "backup_power": c("backup_power").isNull(), "parking": maybe("parking").isNull(), "deposit": c("deposit_months").isNull(), "match_score": c("score").isNull(), "risk_score": maybe("risk_score").isNull(), "travel_time": maybe("travel_minutes").isNull(),
    }
    told = rows.withColumn("open", F.array_sort(F.array_compact(F.array(*[F.when(on, F.lit(n)) for n, on in empty.items()]))))
    place = Window.partitionBy(group).orderBy(F.desc(F.coalesce("score", F.lit(-1))), F.size("open"), "price_uah", F.desc(F.coalesce("total_area", F.lit(0))), "id")
    ranked = told.withColumns({"place": F.row_number().over(place), "second": F.lead(F.coalesce("score", F.lit(0))).over(place)})
    best = F.max_by(F.struct("id", "title", "score", "second"), -c("place")).alias("best")
    found = ranked.groupBy(group).agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_set("open")))).alias("all"))
    score, second = c("best.score"), c("best.second")
    decisive = score.isNotNull() & (second.isNull() | (score - second >= lead))
    say = F.when(decisive, F.concat(F.lit("Для заданого пошукового профілю найсильніший збіг — '"), c("best.title"), F.lit("' із Match Score "), score.cast("string"), F.lit("%. Перед рішенням перевірте заставу, комісію та всі невідомі параметри.")))
    say = say.when(score.isNotNull(), "Різниця між найкращими варіантами незначна, тому немає достатніх підстав називати одну квартиру однозначно найкращою. Порівняйте локацію, заставу та невідомі умови.")
    say = say.otherwise(F.concat(F.lit("Без пошукового профілю система не робить персонального висновку. Найдешевший варіант — '"), c("best.title"), F.lit("', але ціна сама по собі не визначає якість квартири.")))
    return found.select(group, F.when(decisive, c("best.id")).alias("recommended"), decisive.alias("decisive"), F.array_join("all", ",").alias("unknowns"), say.alias("recommendation"))
