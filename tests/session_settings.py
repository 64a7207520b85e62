"""Session settings for a block of a test."""

from contextlib import contextmanager


@contextmanager
def settings(session, **values):
    """Session settings, dots written as __, for the length of a block."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: session.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            session.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            session.conf.unset(name) if value is None else session.conf.set(name, value)
