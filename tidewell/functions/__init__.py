"""Column helpers shared by the operators."""

from tidewell.functions.times import day_text, from_micros, micros, second_text

__all__ = ["day_text", "from_micros", "micros", "second_text"]
