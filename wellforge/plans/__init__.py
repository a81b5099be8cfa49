"""wellforge.plans"""
