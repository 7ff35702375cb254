"""Derived vocabularies: denylists, resolvers, canonical names."""

from __future__ import annotations

import _compat_pickle
import importlib
from functools import lru_cache

from carvelake.functions import fixed_values as V

# Callables whose result denotes an attribute or a module, or forces a deferred one.
#: name -> position of the object (-1: the name holds the module) and of the name.
ATTRIBUTE_RESOLVERS = {
    "builtins.getattr": (0, 1), "__builtin__.getattr": (0, 1), "getattr": (0, 1), "operator.attrgetter": (0, 1),
    "test.support.get_attribute": (0, 1), "unittest.mock._dot_lookup": (0, 1), "xmlrpc.server.resolve_dotted_attribute": (0, 1),
    "lib2to3.fixer_util.attr_chain": (0, 1), "numpy.core._ufunc_reconstruct": (0, 1), "numpy._core._ufunc_reconstruct": (0, 1),
    "numpy.core.__init__._ufunc_reconstruct": (0, 1), "numpy._core.__init__._ufunc_reconstruct": (0, 1),
    "torch._utils._import_dotted_name": (-1, 0), "IPython.utils.importstring.import_item": (-1, 0), "sympy.utilities.source.get_class": (-1, 0), "pydoc.locate": (-1, 0),
}
GENERATOR_RESOLVERS = {"lib2to3.fixer_util.attr_chain"}
MODULE_RESOLVERS = {"importlib.import_module": 0, "builtins.__import__": 0, "__builtin__.__import__": 0, "__import__": 0, "importlib._bootstrap._find_and_load": 0}
FORCING = {"builtins.next": True, "__builtin__.next": True, "next": True, "builtins.iter": False, "__builtin__.iter": False, "iter": False}
#: canonical name -> argument positions that are names.
NAME_POSITIONS = {
    "builtins.getattr": [1], "operator.attrgetter": [0, 1, 2, 3], "test.support.get_attribute": [1], "unittest.mock._dot_lookup": [1],
    "xmlrpc.server.resolve_dotted_attribute": [1], "lib2to3.fixer_util.attr_chain": [1], "numpy.core._ufunc_reconstruct": [1],
    "torch._utils._import_dotted_name": [0], "IPython.utils.importstring.import_item": [0], "sympy.utilities.source.get_class": [0], "pydoc.locate": [0],
    "importlib.import_module": [0], "builtins.__import__": [0], "builtins.setattr": [1], "builtins.hasattr": [1],
    "operator.getitem": [1], "operator.itemgetter": [0, 1, 2, 3], "operator.methodcaller": [0],
}
#: canonical name -> argument positions that are code.
CODE_POSITIONS = {
    "builtins.eval": [0], "builtins.exec": [0], "builtins.compile": [0], "builtins.execfile": [0],
    "os.system": [0], "os.popen": [0], "subprocess.getoutput": [0], "subprocess.getstatusoutput": [0],
}
#: accelerator module -> public module.
MODULE_ALIASES = {
    "_abc": "abc", "_ast": "ast", "_bisect": "bisect", "_codecs": "codecs", "_collections": "collections", "_csv": "csv", "_datetime": "datetime",
    "_decimal": "decimal", "_functools": "functools", "_hashlib": "hashlib", "_heapq": "heapq", "_io": "io", "_operator": "operator", "_pickle": "pickle",
    "_queue": "queue", "_socket": "socket", "_ssl": "ssl", "_statistics": "statistics", "_struct": "struct", "_warnings": "warnings", "_weakref": "weakref", "posix": "os",
}


_GIVEN: dict[str, frozenset[str]] = {}


@lru_cache(maxsize=1)
def _own_aliases() -> dict[str, frozenset[str]]:
    out = {}
    for module, public in MODULE_ALIASES.items():
        try:
            own, other = importlib.import_module(module), importlib.import_module(public)
        except ImportError:
            continue
        out[module] = frozenset(n for n in dir(own) if not n.startswith("__") and getattr(other, n, None) is getattr(own, n))
    return out


def alias_names() -> dict[str, frozenset[str]]:
    """Names that an accelerator module and its public module share.

    The rule is applied once, to the driver's Python, and its table is sent along with every plan, so that all workers
    fold alike; `use_aliases` sets another table, such as one that was written down before.
    """
    return _GIVEN or _own_aliases()


def use_aliases(names: dict[str, frozenset[str]]) -> None:
    if names != _GIVEN:
        _GIVEN.clear()
        _GIVEN.update(names)
        canonical.cache_clear()
        denied.cache_clear()


@lru_cache(maxsize=65_536)
def canonical(module: str, name: str, protocol: int) -> tuple[str, bool]:
    """Canonical dotted name, and whether it names nothing under this protocol."""
    lost = False
    if protocol < 3:
        if (module, name) in _compat_pickle.NAME_MAPPING:
            module, name = _compat_pickle.NAME_MAPPING[module, name]
        elif module in _compat_pickle.IMPORT_MAPPING:
            module = _compat_pickle.IMPORT_MAPPING[module]
    else:
        lost = (module, name) in _compat_pickle.NAME_MAPPING or module in _compat_pickle.IMPORT_MAPPING
    if name in alias_names().get(module, ()):
        module = MODULE_ALIASES[module]
    return (f"{module}.{name}" if module else name), lost


@lru_cache(maxsize=1)
def denylist() -> frozenset[str]:
    """Callables that are hits whenever they are invoked: the list, and indicators never seen in benign files."""
    return frozenset(V.DENYLIST) | {n for n, benign, *_ in V.CALLABLE_STANDALONE + V.CALLABLE_COMBINATION if not benign}


@lru_cache(maxsize=1)
def gateways() -> frozenset[str]:
    return frozenset(V.DENYLIST) | frozenset(V.BYTES_DENYLIST)


@lru_cache(maxsize=65_536)
def denied(qualname: str) -> bool:
    if qualname in denylist():
        return True
    module, _, name = qualname.rpartition(".")
    return bool(module) and canonical(module, name, 0)[0] in denylist()
