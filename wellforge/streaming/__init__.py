"""wellforge.streaming"""
