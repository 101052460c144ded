"""Which profiles apply to a file, and the registry that user profiles join."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_MIME_TYPE, PROFILE_ROUTES
from ..functions import paths

ProfileFunction = Callable[[Column], Column]


@dataclass(frozen=True)
class Route:
    """A profile name, the suffixes it takes and the MIME prefixes it takes."""

    name: str
    suffixes: tuple[str, ...] = ()
    mime_prefixes: tuple[str, ...] = ()

    def applies(self, suffix: Column, mime_type: Column) -> Column:
        tests = [F.lit(False)]
        if self.suffixes:
            tests.append(suffix.isin(list(self.suffixes)))
        tests += [F.startswith(mime_type, F.lit(p)) for p in self.mime_prefixes]
        matched = tests[0]
        for test in tests[1:]:
            matched = matched | test
        return F.coalesce(matched, F.lit(False))


BUILTIN_ROUTES = [Route(n, tuple(s), tuple(m)) for n, s, m in PROFILE_ROUTES]


@dataclass
class Registry:
    """The built-in routes plus user profiles, in the order they are merged."""

    routes: list[Route] = field(default_factory=lambda: list(BUILTIN_ROUTES))
    functions: dict[str, ProfileFunction] = field(default_factory=dict)

    def register_extractor(
        self,
        name: str,
        suffixes: Iterable[str] = (),
        mime_prefixes: Iterable[str] = (),
        fn: ProfileFunction | None = None,
    ) -> None:
        """Add a profile. ``fn`` maps the content column to a struct column; it may be
        built from column functions or from a vectorised UDF. Registering a name again
        changes nothing."""
        if any(route.name == name for route in self.routes):
            return
        self.routes.append(
            Route(name, tuple(s.lower() for s in suffixes), tuple(mime_prefixes))
        )
        if fn is not None:
            self.functions[name] = fn


default_registry = Registry()


def register_extractor(
    name: str,
    suffixes: Iterable[str] = (),
    mime_prefixes: Iterable[str] = (),
    fn: ProfileFunction | None = None,
) -> None:
    """Add a user profile to the default registry."""
    default_registry.register_extractor(name, suffixes, mime_prefixes, fn)


def applicable_profiles(
    path: Column, mime_type: Column, routes: Sequence[Route] = BUILTIN_ROUTES
) -> Column:
    """The names of the profiles that apply, in merge order.

    The routes are known when the plan is built, so this is a row-local expression
    rather than a join with a routing table.
    """
    suffix = paths.extension(path)
    # A type that was not recognised routes nowhere.
    known = F.when(mime_type != DEFAULT_MIME_TYPE, mime_type)
    return F.array_compact(
        F.array(*[F.when(r.applies(suffix, known), F.lit(r.name)) for r in routes])
    )


def route_extractors(df: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Add ``profiles``: for each file the ordered list of profiles that apply."""
    routes = (registry or default_registry).routes
    return df.withColumn(
        "profiles", applicable_profiles(F.col("path"), F.col("mime_type"), routes)
    )
