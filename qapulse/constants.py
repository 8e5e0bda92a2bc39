"""Fixed analysis-window dates; every operator takes them as overridable arguments."""

from datetime import date

START = date(2020, 1, 1)
RELEASE = date(2022, 11, 30)
