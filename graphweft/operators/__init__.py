"""Operators on graphs and on what is retrieved from them, as DataFrame plans."""
