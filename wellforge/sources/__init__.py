"""wellforge.sources"""
