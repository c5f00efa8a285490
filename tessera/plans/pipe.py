"""A grammar of verbs: ``pipe(cube) | verb(...) | verb(...)``."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any


class Verb:
    """A callable step; a pass-through step is run for its effect and hands its input on."""

    def __init__(self, run: Callable[[Any], Any], name: str = "verb", passthrough: bool = False):
        self.run, self.name, self.passthrough = run, name, passthrough

    def __call__(self, value: Any) -> Any:
        out = self.run(value)
        return value if self.passthrough else out

    def __repr__(self) -> str:
        return f"<verb {self.name}>"


class Pipe:
    """A value on its way through verbs; plans stay lazy until someone acts on them."""

    def __init__(self, value: Any, seen: Any = None):
        self.value, self.seen = value, seen

    def __or__(self, verb: Callable[[Any], Any]) -> Pipe:
        if not callable(verb):
            raise TypeError(f"{verb!r} is no verb")
        if isinstance(verb, Verb) and verb.passthrough:
            return Pipe(self.value, verb.run(self.value))
        return Pipe(verb(self.value), self.seen)

    def unwrap(self) -> Any:
        return self.value

    v = property(unwrap)

    def __repr__(self) -> str:
        return f"Pipe({self.value!r})"


def pipe(value: Any) -> Pipe:
    return value if isinstance(value, Pipe) else Pipe(value)


def verb(function: Callable) -> Callable[..., Verb]:
    """Turn ``f(cube, ...)`` into a verb factory ``f(...)``; called with a cube first, it acts at once."""

    @functools.wraps(function)
    def factory(*args: Any, **options: Any) -> Any:
        from .cube import Cube

        if args and isinstance(args[0], Cube):
            return function(*args, **options)
        return Verb(lambda cube: function(cube, *args, **options), function.__name__)

    return factory


def apply(function: Callable, **options: Any) -> Verb:
    """Any function of the whole cube as a verb."""
    return Verb(lambda cube: function(cube, **options), getattr(function, "__name__", "apply"))


def tap(function: Callable) -> Verb:
    """A function run for its effect; the pipe goes on with its input."""
    return Verb(function, getattr(function, "__name__", "tap"), passthrough=True)
