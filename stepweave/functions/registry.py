"""User functions that a program may call in yields."""

from __future__ import annotations

import atexit
import inspect
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager


class Functions(dict):
    """Names to callables of strings that return a string; ``initialize`` runs on the driver before a run, ``finalize`` when its result, or these functions, are closed."""

    def __init__(self, functions: dict[str, Callable[..., str]] | Iterable[Callable[..., str]] = (), initialize: Callable[[], None] | None = None, finalize: Callable[[], None] | None = None):
        super().__init__(functions if isinstance(functions, dict) else {f.__name__: f for f in functions})
        self.initialize, self.finalize, self.is_open = initialize, finalize, False

    def add(self, f: Callable[..., str]) -> Callable[..., str]:
        """As a decorator."""
        self[f.__name__] = f
        return f

    def check(self, name: str, n_args: int) -> None:
        if name not in self:
            raise ValueError(f"The program calls {name}, which isn't among its functions")
        try:
            inspect.signature(self[name]).bind(*[""] * n_args)
        except TypeError as e:
            raise ValueError(f"{name} can't be called with {n_args} arguments: {e}") from None

    def open(self) -> None:
        """Runs ``initialize`` unless that has been done and not been closed."""
        if not self.is_open:
            self.is_open = True
            if self.initialize:
                self.initialize()
            atexit.register(self.close)

    def close(self) -> None:
        """Runs ``finalize`` once; after the last action that calls the functions, or when the process ends."""
        if self.is_open:
            self.is_open = False
            atexit.unregister(self.close)
            if self.finalize:
                self.finalize()

    @contextmanager
    def around(self) -> Iterator[None]:
        """For runs and their actions: results are computed when they are asked for."""
        self.open()
        try:
            yield
        finally:
            self.close()
