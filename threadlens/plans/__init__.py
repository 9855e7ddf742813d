"""threadlens.plans"""
