"""Connected components, as the rest of the library finds them."""

from setloom.operators.graph import link_components as components  # noqa: F401
