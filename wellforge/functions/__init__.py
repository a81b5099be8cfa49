"""wellforge.functions"""
