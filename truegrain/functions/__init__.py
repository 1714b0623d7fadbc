"""Column expressions shared by the operators."""

from .cells import *  # noqa: F403
from .dates import *  # noqa: F403
from .numbers import *  # noqa: F403
from .personal import *  # noqa: F403
from .text import *  # noqa: F403
from .types import *  # noqa: F403
