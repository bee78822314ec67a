"""Constants of the coding standard.  Fixed values, in natural order."""

#: Band widths of a 128-line short window at 48 and 44.1 kHz, and of a 1024-line long window at the same rates.
SHORT_48 = [4, 4, 4, 4, 4, 8, 8, 8, 12, 12, 12, 16, 16, 16]
LONG_48 = [4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 8, 8, 8, 8, 12, 12, 12, 12, 16, 16, 20, 20, 24, 24, 28, 28, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 96]
#: The same at the other rates, by the highest rate that has them.
LONG_96 = [4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 8, 8, 12, 12, 12, 12, 12, 16, 16, 24, 28, 36, 44, 64, 64, 64, 64, 64, 64, 64, 64, 64, 64, 64]
SHORT_96 = [4, 4, 4, 4, 4, 4, 8, 8, 8, 16, 28, 36]
LONG_64 = [4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 8, 12, 12, 12, 16, 16, 16, 20, 24, 24, 28, 36, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40, 40]
LONG_32 = [4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 8, 8, 8, 8, 12, 12, 12, 12, 16, 16, 20, 20, 24, 24, 28, 28, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32]
LONG_24 = [4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 12, 12, 12, 12, 16, 16, 16, 20, 20, 24, 24, 28, 28, 32, 36, 36, 40, 44, 48, 52, 52, 64, 64, 64, 64, 64]
SHORT_24 = [4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 12, 12, 16, 16, 20]
LONG_16 = [8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 12, 12, 12, 12, 12, 12, 12, 12, 12, 16, 16, 16, 16, 20, 20, 20, 24, 24, 28, 28, 32, 36, 40, 40, 44, 48, 52, 56, 60, 64, 64, 64]
SHORT_16 = [4, 4, 4, 4, 4, 4, 4, 4, 8, 8, 12, 12, 16, 20, 20]
LONG_8 = [12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 16, 16, 16, 16, 16, 16, 16, 20, 20, 20, 20, 24, 24, 24, 28, 28, 32, 36, 36, 40, 44, 48, 52, 56, 60, 64, 80]
SHORT_8 = [4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 8, 12, 16, 20, 20]
#: Most bands that a noise-shaping filter reaches, for long and short windows, by sampling-rate index.
FILTER_BANDS = [(31, 9), (31, 9), (34, 10), (40, 14), (42, 14), (51, 14), (46, 14), (46, 14), (42, 14), (42, 14), (42, 14), (39, 14)]
#: Least rate of each sampling-rate index 0 to 11.
RATE_BOUNDARIES = [92017, 75132, 55426, 46009, 37566, 27713, 23004, 18783, 13856, 11502, 9391, 0]
#: Sampling rates by index.
RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
#: Quiet threshold in dB by whole Bark.
QUIET_DB = [15, 10, 7, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3, 5, 10, 20, 30]
#: Lengths of short-window groups by the sub-block of an attack.
GROUPING = [[1, 3, 3, 1], [1, 1, 3, 3], [2, 1, 3, 2], [3, 1, 3, 1], [3, 1, 1, 3], [3, 2, 1, 2], [3, 3, 1, 1], [3, 3, 1, 1]]
#: Stereo downmix gains by layout: input column to (left, right); columns front pair, centre, (LFE,) rear.
DOWNMIX = {
    "5.0": [(0.377358491, 0.0), (0.0, 0.377358491), (0.293405304, 0.293405304), (0.293405304, 0.0), (0.0, 0.293405304)],
    "5.1": [(0.377358491, 0.0), (0.0, 0.377358491), (0.266832747, 0.266832747), (0.088944249, 0.088944249), (0.266832747, 0.0), (0.0, 0.266832747)],
    "7.0": [(0.377358491, 0.0), (0.0, 0.377358491), (0.227365525, 0.227365525), (0.227365525, 0.0), (0.0, 0.227365525), (0.227365525, 0.0), (0.0, 0.227365525)],
    "7.1": [(0.377358491, 0.0), (0.0, 0.377358491), (0.211076651, 0.070358884), (0.070358884, 0.211076651), (0.211076651, 0.0), (0.0, 0.211076651), (0.211076651, 0.0), (0.0, 0.211076651)],
}
#: Decoded channel that stands in each downmix column.
DOWNMIX_ORDER = {"5.0": [1, 2, 0, 3, 4], "5.1": [1, 2, 0, 5, 3, 4], "7.0": [1, 2, 0, 3, 4, 5, 6], "7.1": [1, 2, 0, 7, 3, 4, 5, 6]}


def offsets(widths: list[int]) -> list[int]:
    out = [0]
    for w in widths:
        out.append(out[-1] + w)
    return out


def rate_index(hz: int) -> int:
    return next(k for k, least in enumerate(RATE_BOUNDARIES) if hz >= least)


def band_widths(hz: int, short: bool) -> list[int]:
    """Band widths of a 1024-line long or a 128-line short window."""
    k = rate_index(hz)
    long_tables = [LONG_96, LONG_96, LONG_64, LONG_48, LONG_48, LONG_32, LONG_24, LONG_24, LONG_16, LONG_16, LONG_16, LONG_8]
    short_tables = [SHORT_96, SHORT_96, SHORT_96, SHORT_48, SHORT_48, SHORT_48, SHORT_24, SHORT_24, SHORT_16, SHORT_16, SHORT_16, SHORT_8]
    return (short_tables if short else long_tables)[k]
