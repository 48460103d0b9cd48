"""Tidemark: analytics over multi-source, time-stamped content feeds, written as Spark plans."""
