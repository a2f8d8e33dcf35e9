"""What Python workers keep from one task to the next."""

import sys
import types


def kept(key, make):
    """make()'s value, made once in this worker process."""
    store = sys.modules.setdefault("_nearshelf_kept", types.ModuleType("_nearshelf_kept"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]
