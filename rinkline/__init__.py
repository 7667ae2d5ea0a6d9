"""Rinkline: player-season analytics as Spark DataFrame jobs."""
