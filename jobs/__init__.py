"""Runnable jobs over tables of files; each has a function that takes a session, and a command line."""
