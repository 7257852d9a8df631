"""Streaming use of the row-wise operators.

The reference has no streams (all inputs are whole files). The row-wise parts of the library
(text parsing S1, date building P1, period labels P5, calendar features P3/P4, the monthly join J2
and the event-day flag of W2 against a fixed threshold table) need no state, so they run
unchanged on a streaming DataFrame; ``daily_stream`` wires them to a folder of daily files.
"""

from hydroframe.streaming.daily import daily_stream, flag_event_days  # noqa: F401
