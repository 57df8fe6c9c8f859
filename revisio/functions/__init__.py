from revisio.functions.rng import h, u32, randint, draw_key  # noqa: F401
from revisio.functions.text import words, n_words, strip, WS_CLASS  # noqa: F401
