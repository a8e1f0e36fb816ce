"""Spark jobs for sky-camera and photovoltaic-power data, and corpus operators."""
