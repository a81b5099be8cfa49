"""wellforge.operators"""
