"""Named sources: where a pair of tables lies, its domain, and whether it is held out of training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    name: str
    url: str
    table_a: str
    table_b: str
    domain: str
    held_out: bool = False


class Registry:
    def __init__(self, *sources: Source):
        self.sources = {s.name: s for s in sources}

    def add(self, source: Source) -> None:
        self.sources[source.name] = source

    def get(self, name: str) -> Source:
        if name not in self.sources:
            raise ValueError(f"unknown source: {name}; there are {', '.join(sorted(self.sources)) or 'none'}")
        return self.sources[name]

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row for each source; training takes those that are not held out."""
        rows = [(s.name, s.url, s.table_a, s.table_b, s.domain, s.held_out) for s in self.sources.values()]
        return spark.createDataFrame(rows, "name string, url string, table_a string, table_b string, domain string, held_out boolean")


# The public entity-resolution sources, their tables and domains, and those that are held out of training
PUBLIC_URL = "http://pages.cs.wisc.edu/~anhai/data/784_data"
PUBLIC_TABLES = [
    ("restaurants1", "zomato", "yelp", "restaurants"),
    ("bikes", "bikedekho", "bikewale", "bikes"),
    ("movies1", "rotten_tomatoes", "imdb", "movies"),
    ("movies2", "imdb", "tmd", "movies"),
    ("movies3", "imdb", "rotten_tomatoes", "movies"),
    ("movies4", "amazon", "rotten_tomatoes", "movies"),
    ("movies5", "roger_ebert", "imdb", "movies"),
    ("restaurants2", "zomato", "yelp", "restaurants"),
    ("restaurants3", "yelp", "yellow_pages", "restaurants"),
    ("restaurants4", "yellow_pages", "yelp", "restaurants"),
    ("electronics", "amazon", "best_buy", "electronics"),
    ("music", "itunes", "amazon_music", "music"),
    ("cosmetics", "amazon", "sephora", "cosmetics"),
    ("beer", "beer_advocate", "rate_beer", "beer"),
    ("anime", "my_anime_list", "anime_planet", "anime"),
    ("books1", "amazon", "barnes_and_noble", "books"),
    ("books2", "goodreads", "barnes_and_noble", "books"),
    ("books3", "barnes_and_noble", "half", "books"),
    ("books4", "amazon", "barnes_and_noble", "books"),
    ("books5", "amazon", "barnes_and_noble", "books"),
    ("ebooks1", "itunes", "ebooks", "ebooks"),
    ("ebooks2", "itunes", "ebooks", "ebooks"),
    ("citations", "google_scholar", "dblp", "bibliography"),
    ("baby_products", "babies_r_us", "buy_buy_baby", "baby products"),
]
HELD_OUT = ("electronics", "restaurants3", "books2", "anime", "citations")


def public_sources() -> Registry:
    return Registry(*(Source(name, f"{PUBLIC_URL}/{name}.tar.gz", a, b, domain, name in HELD_OUT) for name, a, b, domain in PUBLIC_TABLES))
