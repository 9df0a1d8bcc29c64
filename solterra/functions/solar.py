"""Closed-form position of the sun (low-precision almanac formulae), as SQL text that Spark takes by ``expr``."""

from __future__ import annotations

import numpy as np

_DAYS = "(({t} - 946728000) / 86400.0E0)"
_G = f"radians(357.529E0 + 0.98560028E0 * {_DAYS})"
_L = f"radians(280.459E0 + 0.98564736E0 * {_DAYS} + 1.915E0 * sin({_G}) + 0.020E0 * sin(2 * {_G}))"
_E = f"radians(23.439E0 - 0.00000036E0 * {_DAYS})"
_DECL = f"asin(sin({_E}) * sin({_L}))"
_HOUR = f"(radians((18.697374558E0 + 24.06570982441908E0 * {_DAYS}) * 15 + {{lon}}) - atan2(cos({_E}) * sin({_L}), cos({_L})))"
_ALTITUDE = f"asin(sin(radians({{lat}})) * sin({_DECL}) + cos(radians({{lat}})) * cos({_DECL}) * cos({_HOUR}))"
_AZIMUTH = f"atan2(sin({_HOUR}), cos({_HOUR}) * sin(radians({{lat}})) - tan({_DECL}) * cos(radians({{lat}})))"


def altitude(t: str = "timestamp", lon: str = "lon", lat: str = "lat") -> str:
    """Radians above the horizon at epoch second ``t``."""
    return _ALTITUDE.format(t=t, lon=lon, lat=lat)


def azimuth(t: str = "timestamp", lon: str = "lon", lat: str = "lat") -> str:
    """Radians from south, westward positive."""
    return _AZIMUTH.format(t=t, lon=lon, lat=lat)


_NOON = "({day} + 43200)"
_OFF = "atan2(sin(" + _HOUR.format(t=_NOON, lon="{lon}") + "), cos(" + _HOUR.format(t=_NOON, lon="{lon}") + "))"
_COS_H = "((sin(radians(-0.833E0)) - sin(radians({lat})) * sin(" + _DECL.format(t=_NOON) + ")) / (cos(radians({lat})) * cos(" + _DECL.format(t=_NOON) + ")))"


def _event(sign: str, day: str, lon: str, lat: str) -> str:
    half = f"acos(greatest(-1.0E0, least(1.0E0, {_COS_H})))"
    moment = f"({_NOON} - {_OFF} / (2 * pi()) * 86400 {sign} {half} / (2 * pi()) * 86400)"
    return f"CASE WHEN abs({_COS_H}) <= 1 THEN {moment} END".format(day=day, lon=lon, lat=lat)


def sunrise(day: str = "day", lon: str = "lon", lat: str = "lat") -> str:
    """Epoch second at which the sun's upper edge rises about the noon of the UTC day that begins at ``day``; null where it does not."""
    return _event("-", day, lon, lat)


def sunset(day: str = "day", lon: str = "lon", lat: str = "lat") -> str:
    return _event("+", day, lon, lat)


def _place(t):
    """(declination, Greenwich hour angle) of the sun at epoch seconds t, by the same formulae over arrays."""
    days = (t - 946728000) / 86400.0
    g = np.radians(357.529 + 0.98560028 * days)
    length = np.radians(280.459 + 0.98564736 * days + 1.915 * np.sin(g) + 0.020 * np.sin(2 * g))
    tilt = np.radians(23.439 - 0.00000036 * days)
    return np.arcsin(np.sin(tilt) * np.sin(length)), np.radians((18.697374558 + 24.06570982441908 * days) * 15) - np.arctan2(np.cos(tilt) * np.sin(length), np.cos(length))


def altitude_at(t, lon, lat):
    """As ``altitude``, over arrays."""
    decl, hour = _place(t)
    return np.arcsin(np.clip(np.sin(np.radians(lat)) * np.sin(decl) + np.cos(np.radians(lat)) * np.cos(decl) * np.cos(hour + np.radians(lon)), -1.0, 1.0))


def position_at(t, lon, lat):
    """(``altitude``, ``azimuth``) over arrays."""
    decl, hour = _place(t)
    hour, lat = hour + np.radians(lon), np.radians(lat)
    up = np.arcsin(np.clip(np.sin(lat) * np.sin(decl) + np.cos(lat) * np.cos(decl) * np.cos(hour), -1.0, 1.0))
    return up, np.arctan2(np.sin(hour), np.cos(hour) * np.sin(lat) - np.tan(decl) * np.cos(lat))


def crossing(noon, lon, lat, limit, up: bool):
    """Epoch second, within about a second, at which the sun passes the altitude ``limit`` before a noon (``up``) or after it."""
    t, sign = noon, 1 if up else -1
    for _ in range(3):
        decl, hour = _place(t)
        hour = np.arctan2(np.sin(hour + np.radians(lon)), np.cos(hour + np.radians(lon)))
        half = np.arccos(np.clip((np.sin(limit) - np.sin(np.radians(lat)) * np.sin(decl)) / (np.cos(np.radians(lat)) * np.cos(decl)), -1.0, 1.0))
        t = t - (hour + sign * half) / (2 * np.pi) * 86400
    return t
