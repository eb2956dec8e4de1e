"""Column builders: every function here takes and returns ``Column``s and
stays inside whole-stage codegen (no Python UDFs)."""
from .text import *  # noqa: F401,F403
from .scoring import *  # noqa: F401,F403
